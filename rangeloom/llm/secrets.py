"""Secret scans: base patterns plus sliding-window entropy of candidate strings.

Base kinds, leftmost and non-overlapping per kind: assign (a key word, `:` or `=`, a value of 8 characters or more),
access (AKIA and 12 characters or more), hex (32 hex digits or more). The entropy kind adds spans: candidate strings
of the value alphabet are put in a character class (hex, base32, base64, words); a window slides over the candidate
and its Shannon entropy is kept by incremental counts - one character leaves, one enters; windows at or over the
class's threshold are merged to spans. Candidates that the allow-list knows (UUIDs, dates and versions, words joined
by dashes or dots, paths, one repeated pattern) are suppressed; base spans never are.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; equal spans of different
kinds are listed in the order of the kinds. Repeated rows give equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns. Only the key words' letters are in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Class, pattern of a whole candidate, least entropy in bits a character of a window.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("base32", re.compile(r"[A-Z2-7]+=*"), 3.4),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+={0,2}"), 3.7),
    ("mixed", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+"), 3.6),
)
#: Strings that look random but are known to be none.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9_=+/-]+"),
    re.compile(r"(?:[A-Za-z]{1,24}[-_/=+]+)+[A-Za-z]{0,24}[0-9]{0,4}"),
    re.compile(r"(.{1,8}?)\1{2,}.{0,8}"),
)


def entropies(text: str, window: int = WINDOW) -> list[float]:
    """The entropy of each window of the text, by incremental counts."""
    n = min(window, len(text))
    counts: dict[str, int] = {}
    for c in text[:n]:
        counts[c] = counts.get(c, 0) + 1
    term = [0.0] + [k * log2(k) for k in range(1, n + 1)]
    total = sum(term[k] for k in counts.values())
    base = log2(n) if n else 0.0
    out = [base - total / n] if n else []
    for i in range(n, len(text)):
        gone, new = text[i - n], text[i]
        if gone != new:
            k = counts[gone]
            total += term[k - 1] - term[k]
            counts[gone] = k - 1
            k = counts.get(new, 0)
            total += term[k + 1] - term[k]
            counts[new] = k + 1
        out.append(base - total / n)
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    spans = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        least = next((t for _, pattern, t in CLASSES if pattern.fullmatch(s)), None)
        if least is None or any(p.fullmatch(s) for p in ALLOWED):
            continue
        begin = end = -1
        for i, h in enumerate(entropies(s)):
            if h >= least:
                if begin >= 0 and i <= end:
                    end = i + WINDOW
                else:
                    if begin >= 0:
                        spans.append((m.start() + begin, m.start() + min(end, len(s))))
                    begin, end = i, i + WINDOW
        if begin >= 0:
            spans.append((m.start() + begin, m.start() + min(end, len(s))))
    return spans


def _assign_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    spans = [(a, 0, b) for a, b in _assign_spans(text)] if (":" in text or "=" in text) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts per kind, the digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                more = [(a, 3, e) for a, e in entropy_spans(text)]
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by the name of its kind in brackets; all columns are kept."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                if text is not None:
                    parts, last = [], 0
                    for a, k, e in sorted(base_spans(text) + [(a, 3, e) for a, e in entropy_spans(text)]):
                        if e <= last:
                            continue
                        parts += [text[last : max(a, last)], f"[{KINDS[k]}]" if a >= last else ""]
                        last = e
                    text = "".join(parts) + text[last:]
                out.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
