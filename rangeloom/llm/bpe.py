"""BPE encoding and decoding with a given vocabulary (tokenizers format), by tree concatenation.

Text no longer than `leaf_chars` is encoded where it is read. Longer text is cut blindly into leaves, which Spark
deals out and encodes in parallel; neighbouring leaves are then joined as a binary tree. At each join a window around
the cut is encoded anew and grown until its tokens agree with the left part's and the right part's over a run of
`RUN` tokens each, by id and place; left part, window and right part are then spliced in the middle of the runs.
BPE decides a merge by neighbouring symbols only and the split pattern goes on from the end of its last match, so
beyond such a run both encodings go on alike. How long a run it takes depends on the text, so a splice counts only
when the next window, four times as wide, gives the very same tokens; else windows go on growing. A window that would
cover both parts is the encoding of the whole.

Within a leaf, a cut at ASCII white space is safe (white space is never part of a token and never combines),
so units between such cuts are encoded once and remembered, up to a bound. This and lower-casing hold for vocabularies
that drop white space and case and split letters, digits and other signs; with others a leaf is encoded as it is.

Defined results: a null text is an empty one; empty text has no tokens and decodes to "". Special tokens' strings in
a text are special tokens, as the library has it. Repeated rows give repeated results; an empty table gives none.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: Code points in a leaf; longer text is encoded in parts.
LEAF_CHARS = 32_768
#: Tokens that a window and a part must agree on, on either side.
RUN = 8
#: About the bytes that a worker's memory of units takes, those of each entry besides its own, and the longest unit kept.
MEMO_BYTES, ENTRY_BYTES, MEMO_CHARS = 160 << 20, 190, 64

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself where it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b if b in visible else next(more)) for b in range(256)]


#: Below this, letters are composed, lower() is as plain as the vocabulary's, and words are one match of the split pattern.
LATIN = "\u0250"
_SIGNS = {c: "".join(_byte_signs()[b] for b in chr(c).encode()) for c in range(128, ord(LATIN))}


class Encoder:
    """The vocabulary and what a worker remembers of it."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.most: int | None = None  # bytes to remember, where they aren't MEMO_BYTES
        self.memo: dict[str, bytes]
        self.cores: dict[str, bytes]
        self.forget()
        n = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.pieces = [self.tok.id_to_token(i) or "" for i in range(n)]
        self.joined = self.tok.decoder is None  # then decoding joins the tokens by spaces
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        # whether white space is dropped, case doesn't count and marks are set apart: else texts are encoded whole
        self.by_units = all(ids(t) == [i for u in parts for i in ids(u)] for t, parts in (("Ab c", ["ab", "c"]), (" THE\n\tend. ", ["the", "end", "."]), ("x9, Yes!", ["x9", ",", "yes", "!"]), ("it's;", ["it's", ";"])))
        # the merges alone, for words of Latin letters that need no normalising or splitting
        shape = json.loads(self.tok.to_str())
        shape |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(shape)) if self.by_units else None
        trial = ["the", "straße", "señorâ", "œuvre", "xqzj" * 9, "ýþ"]
        if self.merges and any(self.merges.encode(w.translate(_SIGNS), add_special_tokens=False).ids != ids(w) for w in trial):
            self.merges = None

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.memo, self.cores, self.held = {"": b""}, {"": b""}, 0

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        if not self.by_units:
            return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        memo, cores = self.memo, self.cores
        new = set().union(*split).difference(memo)
        if new:
            parts = {u: plain_parts(u) for u in new}
            unknown = {x for pair in parts.values() for x in pair if x not in cores}
            words, signs, rest = [], [], []
            for c in unknown:
                if self.merges and c.isalpha() and (c.isascii() or max(c) < LATIN):
                    words.append(c)
                    signs.append(c if c.isascii() else c.translate(_SIGNS))
                else:
                    rest.append(c)
            got = self.merges.encode_batch_fast(signs, add_special_tokens=False) if words else []
            got += self.tok.encode_batch_fast(rest, add_special_tokens=False)
            for c, e in zip([*words, *rest], got, strict=True):
                cores[c] = pack_ids(e.ids)
            for u, (body, mark) in parts.items():
                memo[u] = cores[body] + cores[mark] if mark else cores[body]
        out = [b"".join(map(memo.__getitem__, s)) for s in split]
        if new:
            for known, fresh in ((memo, new), (cores, unknown)):
                for u in fresh:
                    if len(u) > MEMO_CHARS:
                        del known[u]
                    else:
                        self.held += ENTRY_BYTES + len(u)
            if self.held > (self.most or MEMO_BYTES):
                self.forget()
        return out

    def encode_placed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the code point at which each token starts."""
        e = self.tok.encode(text, add_special_tokens=False)
        return np.asarray(e.ids, np.int64), np.asarray([a for a, _ in e.offsets], np.int64)

    def decode(self, ids: np.ndarray) -> str:
        if self.joined:
            return " ".join(map(self.pieces.__getitem__, ids.tolist()))
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def forget() -> None:
    """Free what this worker remembers, where a later stage has no use for it."""
    for enc in _encoders.values():
        enc.forget()


def plain_parts(unit: str) -> tuple[str, str]:
    """A unit as it is encoded: Latin in lower case, as the vocabulary has it, and the marks that end it after a letter or digit,
    which the split pattern always sets apart, as one piece. Units with a beginning of a special token stay as they are."""
    if not unit or "<|" in unit or not (unit.isascii() or max(unit) < LATIN):
        return unit, ""
    low = unit.lower()
    body = low.rstrip(".,!?;:")
    return (body, low[len(body) :]) if body and body[-1].isalnum() else (low, "")


Part = tuple[str, np.ndarray, np.ndarray]  # text, ids, starts


def _common_run(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], last: bool, run: int) -> tuple[int, int] | None:
    """Indexes in a and b of the middle of a run of tokens with the same ids and places: the last such run or the first."""
    (ia, sa), (ib, sb) = a, b
    if len(ia) < run or len(ib) < run:
        return None
    # a place may hold more than one token, so tokens are matched by place and count within the place
    ka = sa * 64 + (np.arange(len(sa)) - np.searchsorted(sa, sa)).clip(0, 63)
    kb = sb * 64 + (np.arange(len(sb)) - np.searchsorted(sb, sb)).clip(0, 63)
    pos = np.searchsorted(kb, ka).clip(0, len(kb) - 1)
    same = (kb[pos] == ka) & (ib[pos] == ia)
    step = np.ones(len(ia), bool)
    step[1:] = pos[1:] == pos[:-1] + 1
    length = 0
    found = None
    for i in range(len(ia)):
        length = (length + 1 if step[i] and length else 1) if same[i] else 0
        if length >= run:
            found = (i - run // 2, int(pos[i]) - run // 2)
            if not last:
                return found
    return found


def join_parts(encode: Callable[[str], tuple[np.ndarray, np.ndarray]], left: Part, right: Part, window: int = 64, run: int = RUN) -> Part:
    """The encoding of two neighbouring parts' text from their encodings."""
    (lt, li, ls), (rt, ri, rs) = left, right
    text = lt + rt
    if not lt or not rt:
        return (text, li, ls) if lt else (text, ri, rs)
    before: tuple[np.ndarray, np.ndarray] | None = None  # what the window before gave
    while True:
        lo, hi = max(0, len(lt) - window), min(len(rt), window)
        if lo == 0 and hi == len(rt):
            ids, starts = encode(text)
            return text, ids, starts
        wi, ws = encode(lt[lo:] + rt[:hi])
        ws = ws + lo
        cut = len(lt)
        at_left, at_right = (0, 0), (len(ri), len(wi))
        if lo > 0:
            # away from the window's own left end and from the part's right end
            a = np.searchsorted(ls, lo)
            m = np.searchsorted(ws, cut)
            hit = _common_run((li[a:], ls[a:]), (wi[:m], ws[:m]), True, run)
            at_left = None if hit is None else (hit[0] + int(a), hit[1])
        if hi < len(rt):
            b = np.searchsorted(rs, hi)
            m = int(np.searchsorted(ws, cut))
            hit = _common_run((ri[:b], rs[:b] + cut), (wi[m:], ws[m:]), False, run)
            at_right = None if hit is None else (hit[0], hit[1] + m)
        if at_left is not None and at_right is not None and at_left[1] <= at_right[1]:
            i, j, k, n = at_left[0], at_left[1], at_right[1], at_right[0]
            now = np.concatenate([li[:i], wi[j:k], ri[n:]]), np.concatenate([ls[:i], ws[j:k], rs[n:] + cut])
            if before is not None and all(map(np.array_equal, before, now)):
                return text, *now
            before = now
        else:
            before = None
        window *= 4


def join_tree(encode: Callable[[str], tuple[np.ndarray, np.ndarray]], parts: list[Part]) -> Part:
    """Neighbours joined level by level."""
    while len(parts) > 1:
        parts = [join_parts(encode, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(enc: Encoder, doc_ids: list, ids: list[bytes], with_ids: bool, type_of_id: pa.DataType) -> pa.RecordBatch:
    cols = {
        "doc_id": pa.array(doc_ids, type_of_id),
        "n_tokens": pa.array([len(b) // 4 for b in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
        "decoded_sha256": pa.array([hashlib.sha256(enc.decode(np.frombuffer(b, "<u4")).encode()).hexdigest() for b in ids]),
    }
    if with_ids:
        cols["ids"] = pa.array(ids, pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode_decode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for."""
    schema = RESULT + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(path or vocabulary_path())
        for whole in batches:
            for b in _slices(whole):
                yield _rows(enc, b.column(0).to_pylist(), enc.encode_many(b.column(1).to_pylist()), with_ids, pa.int64())

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(path or vocabulary_path())
        for whole in batches:
            for b in _slices(whole, 8):
                got = [enc.encode_placed(t) for t in b.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("row_no"), b.column("doc_id"), b.column("part_no"), b.column("part"), pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary()), pa.array([s.astype("<u4").tobytes() for _, s in got], pa.binary())],
                    names=["row_no", "doc_id", "part_no", "part", "ids", "starts"],
                )

    def tree(group: pa.Table) -> pa.Table:
        enc = Encoder.get(path or vocabulary_path())
        group = group.sort_by("part_no")
        as_ints = lambda c: [np.frombuffer(x, "<u4").astype(np.int64) for x in group[c].to_pylist()]
        parts = list(zip(group["part"].to_pylist(), as_ints("ids"), as_ints("starts"), strict=True))
        _, ids, _ = join_tree(enc.encode_placed, parts)
        return pa.Table.from_batches([_rows(enc, group["doc_id"].to_pylist()[:1], [ids.astype("<u4").tobytes()], with_ids, pa.int64())])

    n = F.char_length("text")
    out = rows.where(n <= leaf_chars).mapInArrow(short, schema)
    at = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / leaf_chars).cast("int")))
    parts = (
        rows.where(n > leaf_chars)
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("part_no", at)
        .select("row_no", "doc_id", "part_no", F.substring("text", F.col("part_no") * leaf_chars + 1, F.lit(leaf_chars)).alias("part"))
    )
    placed = parts.repartition("row_no", "part_no").mapInArrow(leaf, "row_no long, doc_id long, part_no int, part string, ids binary, starts binary")
    return out.unionByName(placed.groupBy("row_no").applyInArrow(tree, schema))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with a binary column `ids` (little-endian unsigned 32-bit; null: none) and its decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.get(path or vocabulary_path())
        for b in batches:
            texts = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
