"""Toxicity scores of noisy-channel deobfuscated text.

1. A character trigram model (letters folded to a-z, space) is counted over all documents, in partial counts per task.
2. Disguised words of any length - leetspeak, masked letters, stretched letters, letters set apart by spaces, dots, dashes - become
   character lattices: every character offers the letters it may stand for, each at a channel cost, and a repeated
   letter may stand for one, two or three letters. Viterbi decoding under the trigram model restores the word.
3. A document's features are its distinct words, plain and restored, and the first five letters of longer ones, hashed.
   Log-odds of the toxic label per feature, less one standard error, come from counts over labelled documents; a
   logistic curve on the strongest five and on the share of such words turns them into a score.

Counting and fitting use a bounded sample of labelled rows (`LABELLED_MOST`, by a hash of doc_id); rows whose
crc32(doc_id as text) mod 4 is 2 are held out. The trigram table (28^3 counts) and the feature table (`BUCKETS` counts
by label) are bounded by parameters, whatever the corpus, and so may pass through the driver.

Defined results: a null or empty text has no features and gets the score of that; labels that are null are not used,
and of several labels of a document all count; without any usable label or with labels of one kind only, every score
is the share of toxic labels, or 0. A null doc_id is not held out. Repeated rows are scored alike; an empty table
gives no rows; other columns are ignored by `score` and kept by `apply`.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Most labelled documents that features are counted on.
LABELLED_MOST = 20_000
BUCKETS = 1 << 18
FOLDS = 3
THRESHOLD = 0.3
#: What a written character may stand for besides itself. Common leetspeak.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Characters that mask any letter inside a word.
MASKS = "*#%_"
COST_LEET, COST_MASK, COST_RUN, COST_GAP = 0.7, 3.2, 0.3, 0.3
SYMBOLS = 28  # 0: no letter, 1 to 26: letters, 27: word end
_FOLD = np.zeros(0x3000, np.uint8)
for _c in range(0x3000):
    _base = unicodedata.normalize("NFKD", chr(_c)).lower()[:1]
    if "a" <= _base <= "z":
        _FOLD[_c] = ord(_base) - 96
_FOLD[ord("ß")] = 19  # sharp s
_EDGES = ".,;:!?%&#*|\"'()[]{}<>~^=`…“”"
#: Closing signs that stand for no letter.
_NO_LETTERS = "".join(c for c in _EDGES if c not in LEET and c not in MASKS)
_LEETISH = "".join(re.escape(c) for c in (*LEET, *MASKS))
#: Signs between letters, a leading sign or stretched letters; signs that follow a word may be punctuation.
_DISGUISED = re.compile(rf"[$@]?[^\W\d_].*[{_LEETISH}][^\W_].*|[$@0-9]+[^\W\d_].*|.*([^\W\d_])\1\1.*", re.S)
#: The same of a word with its closing signs: one of them may be a letter.
_DISGUISED_END = re.compile(rf"[$@]?[^\W\d_].*[{_LEETISH}]|[$@0-9]+[^\W\d_].*[{_LEETISH}]", re.S)
_STRETCHED = re.compile(r"(.)\1\1", re.S)
_GAP = r"\s.\-_*/"
_CLOSING = r".,;:!?\"')\]}>"
#: Three or more single characters with signs or white space between them.
_APART = re.compile(rf"(?<![^\s\"'(\[{{<])[^{_GAP}{_CLOSING}](?:[{_GAP}]+(?:[^{_GAP}{_CLOSING}]|!(?=[{_GAP}]+\w))(?![^{_GAP}{_CLOSING}])){{2,}}")
_APART_PARTS = re.compile(rf"[{_GAP}]+|[^{_GAP}]")


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def folded(text: str) -> np.ndarray:
    """Symbols 0 to 26 of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 0)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """gram, n: over all documents; a gram is three symbols, and 27 stands where a word begins or ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                s = folded("\n".join(b.column(0).slice(i, 512).to_pylist())).astype(np.int32)
                s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])] if len(s) else s  # one mark between words
                s = np.where(s == 0, 27, s)
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """-log P(c | a, b), interpolated with bigrams and letters."""
    n = np.zeros((SYMBOLS,) * 3)
    for g, k in counts:
        n[g // SYMBOLS**2, g // SYMBOLS % SYMBOLS, g % SYMBOLS] = k
    uni = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    bi = (n.sum(0) + 5 * uni) / (n.sum(0).sum(1, keepdims=True) + 5)
    tri = (n + 5 * bi) / (n.sum(2, keepdims=True) + 5)
    return -np.log(tri)


#: A masked letter's place.
_ANY = [(chr(97 + i), COST_MASK) for i in range(26)] + [("", COST_MASK)]


def options(word: str) -> list[list[tuple[str, float]]]:
    """The lattice of a word: per place, the letters (or none) that may stand there and what each costs."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word.lower(), re.S)]
    out = []
    for c, k in runs:
        letter = chr(96 + int(_FOLD[ord(c)])) if ord(c) < len(_FOLD) and _FOLD[ord(c)] else ""
        if letter:
            out.append([(letter, 0.0)])
            for _ in range(min(k, 3) - 1):
                out.append([("", COST_RUN * (k > 2)), (letter, COST_RUN * (k > 2))])
        elif c in LEET:
            out.append([(x, COST_LEET) for x in LEET[c]] + [("", COST_MASK)])
            again = COST_RUN * (k > 2)
            out += [[("", again), *((x, again) for x in LEET[c])]] * (k - 1)
        elif c in MASKS:
            out += [_ANY] * k
        else:
            out.append([("", 0.0)])
    return out


def options_apart(run: str, strict: bool) -> list[list[tuple[str, float]]]:
    """The lattice of letters set apart: signs between them are none or a word's end, asterisks and underscores perhaps letters.

    strict: a letter that comes again is a letter of its own; else it may also be a stretched one.
    """
    parts = _APART_PARTS.findall(run.lower())
    least = min(map(len, parts[1::2]))
    out, last = [], ""
    for i, part in enumerate(parts):
        if i % 2:
            signs = [c for c in part if c in MASKS]
            for _ in signs:
                out.append(_ANY[:-1] + [("", 0.0)])
            # a wider gap than others is rather between words
            out.append([("", COST_GAP), (" ", 0.0)] if len(part) > least else [("", 0.0), (" ", COST_GAP)])
        else:
            place = options(part)[0]
            out.append(place if strict or part != last else [*place, ("", COST_RUN)])
            last = part
    return out


Path = tuple | None  # the path before and its last letter
States = dict[tuple[int, int], tuple[float, Path]]


def _letters(path: Path) -> str:
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _masked(states: States, lm: np.ndarray, none: float) -> tuple[States, bool]:
    """The states after a place that any letter may take, or none at a cost; whether one has become likelier by a letter."""
    at = np.full((SYMBOLS, SYMBOLS), np.inf)
    for key, (cost, _) in states.items():
        at[key] = cost
    total = at[:, :, None] + lm[:, :, 1:27]
    best = total.argmin(0)
    least = np.take_along_axis(total, best[None], 0)[0]
    more = False
    new = {key: (cost + none, path) for key, (cost, path) in states.items()}
    for b, c in zip(*(x.tolist() for x in np.nonzero(np.isfinite(least))), strict=True):
        cost = float(least[b, c]) + COST_MASK
        if (b, c + 1) not in new or cost < new[b, c + 1][0]:
            new[b, c + 1] = (cost, (states[int(best[b, c]), b][1], chr(97 + c)))
            more = True
    return new, more


class Endings:
    """The best readings of masks that close a word, for all last two letters at once.

    A mask costs the same with a letter as with none, so from some number of masks on more of them change nothing.
    """

    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.cost = [lm[:, :, 27].copy()]  # by number of masks: least cost of the rest after letters a, b, without the masks' own
        self.cost[0][:, 27] = 0.0  # a word's end needs no other
        self.letter = [np.zeros((SYMBOLS, SYMBOLS), int)]  # the first of it; 0: none
        self.settled = False

    def after(self, masks: int) -> np.ndarray:
        while len(self.cost) <= masks and not self.settled:
            rest = self.cost[-1]
            each = np.concatenate([rest[:, :, None], self.lm[:, :, 1:27] + rest[None, :, 1:27]], axis=2)
            self.letter.append(each.argmin(2))
            self.cost.append(each.min(2))
            self.settled = not self.letter[-1].any()
        return self.cost[min(masks, len(self.cost) - 1)]

    def letters(self, a: int, b: int, masks: int) -> str:
        out = ""
        for k in range(min(masks, len(self.cost) - 1), 0, -1):
            if c := int(self.letter[k][a, b]):
                out, a, b = out + chr(96 + c), b, c
        return out


def restore(word: str, lm: np.ndarray, endings: Endings | None = None) -> str:
    """The likeliest letters of a disguised word. endings: of the same lm, to be used again."""
    lattice = options(word)
    masks = 0
    while endings is not None and masks < len(lattice) and lattice[-1 - masks] is _ANY:
        masks += 1
    return decode(lattice[: len(lattice) - masks], lm, endings, masks)


def decode(lattice: list[list[tuple[str, float]]], lm: np.ndarray, endings: Endings | None = None, masks: int = 0) -> str:
    """The likeliest path by Viterbi, at most SYMBOLS**2 states a place. A letter is a to z, or a space for a word's end.

    masks: so many closing masks follow the lattice.
    """
    states: States = {(27, 27): (0.0, None)}
    settled = None
    sure: list[str] = []  # what all paths begin with
    for choices in lattice:
        if len(choices) > 26 and len(states) > 4:
            # where a letter more helps no state, further places of the kind don't either
            if settled != choices[-1][1]:
                states, more = _masked(states, lm, choices[-1][1])
                settled = None if more else choices[-1][1]
            continue
        settled = None
        new: States = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in choices:
                if letter:
                    c = 27 if letter == " " else ord(letter) - 96
                    key, total, longer = (b, c), cost + extra + lm[a, b, c], (path, letter)
                else:
                    key, total, longer = (a, b), cost + extra, path
                if key not in new or total < new[key][0]:
                    new[key] = (total, longer)
        states = new
        if len(states) == 1:
            ((key, (cost, path)),) = states.items()
            sure.append(_letters(path))
            states = {key: (cost, None)}
    if masks:
        after = endings.after(masks)
        cost, (a, b) = min((cost + after[key], key) for key, (cost, _) in states.items())
        return "".join(sure) + _letters(states[a, b][1]) + endings.letters(a, b, masks)
    ends = [(cost + (0.0 if b == 27 else lm[a, b, 27]), _letters(path)) for (a, b), (cost, path) in states.items()]
    return "".join(sure) + min(ends)[1]


class Features:
    """Hashed features of words; `MOST` words of at most `LONGEST` characters are remembered."""

    MOST, LONGEST = 200_000, 64

    def __init__(self, lm: np.ndarray):
        self.lm, self.endings = lm, Endings(lm)
        self.memo: dict[str, tuple[int, ...]] = {}

    def _hash(self, word: str) -> list[int]:
        own = [zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS]
        if len(word) > 5:
            own.append(zlib.crc32(b"^" + word[:5].encode("utf-8", "replace")) % BUCKETS)
        return own

    def of_word(self, raw: str) -> tuple[int, ...]:
        if (got := self.memo.get(raw)) is not None:
            return got
        low = raw.lower()
        core = low.strip(_EDGES)
        out = self._hash(core) if len(core) > 1 else []
        if low.isalpha() and not _STRETCHED.search(low):  # nothing but letters: no disguise
            return self._kept(raw, out)
        # a sign that opens a word may be a letter; signs that close it are read as none and as letters
        opened = low.lstrip(".,;:!?%&#*|\"'([{<")
        form = opened.rstrip(_EDGES + "$@")
        forms = [form] if _DISGUISED.fullmatch(form) else []
        for closed in {opened.rstrip(_NO_LETTERS), opened.rstrip(_NO_LETTERS + "!|(")} - {form}:
            if _DISGUISED_END.fullmatch(closed):
                forms.append(closed)
        if not forms and _DISGUISED_END.fullmatch(form):  # a closing figure
            forms.append(form)
        for plain in {restore(f, self.lm, self.endings) for f in forms if len(f) > 2}:
            if len(plain) > 2 and plain != core:
                out += self._hash(plain)
        return self._kept(raw, out)

    def _kept(self, raw: str, out: list[int]) -> tuple[int, ...]:
        got = tuple(out)
        if len(raw) <= self.LONGEST:
            if len(self.memo) >= self.MOST:
                self.memo.clear()
            self.memo[raw] = got
        return got

    def of_run(self, run: str) -> set[int]:
        """Of letters set apart: as one word, and as the words that they are decoded to."""
        glued = re.sub(f"[{_GAP}]+", "", run)
        kinds = set(glued.lower())
        if len(kinds) < 2 or not any(c.isalpha() for c in kinds):  # one letter over and over, or a row of figures
            return set()
        out = set(self.of_word(glued))
        again = re.search(r"(.)\1", glued.lower())
        if again:
            out.update(self.of_word(re.sub(r"(.)\1+", r"\1", glued)))
        for strict in (True, False) if again else (True,):
            for word in set(decode(options_apart(run, strict), self.lm).split()):
                if len(word) > 1:
                    out.update(self._hash(word))
        return out

    def of_text(self, text: str) -> np.ndarray:
        units = set(text.split())
        found: set[int] = set()
        for m in _APART.finditer(text):
            found.update(self.of_run(m[0]))
        for u in units:
            found.update(self.of_word(u))
        return np.fromiter(found, np.int64, len(found))


def feature_counts(labelled: DataFrame, lm: np.ndarray) -> DataFrame:
    """fold, bucket, toxic, clean: labelled documents that have the feature. labelled: text, toxic, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lm)
        counts = np.zeros((FOLDS, 2, BUCKETS), np.int32)
        for b in batches:
            for text, y, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[f, y, features.of_text(text)] += 1
        for f in range(FOLDS):
            at = np.flatnonzero(counts[f].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), *(pa.array(x, pa.int32()) for x in (at, counts[f, 1, at], counts[f, 0, at]))], names=["fold", "bucket", "toxic", "clean"])

    rows = labelled.select("text", "toxic", "fold").mapInArrow(run, "fold int, bucket int, toxic int, clean int")
    return rows.groupBy("fold", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weights(counts: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Per feature, log-odds of the toxic label over the share of toxic labels, less one standard error; 0 where that isn't above 0.

    counts: clean and toxic documents that have the feature; toxic, clean: documents of either label.
    """
    if not toxic or not clean:
        return np.zeros(BUCKETS, np.float32)
    c, t = counts
    share = toxic / (toxic + clean)
    odds = np.log((t + share) / (c + 1 - share)) - np.log(toxic / clean)
    w = np.maximum(0, odds - np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))
    return np.where(c + t > 0, w, 0).astype(np.float32)


def evidence(found: np.ndarray, w: np.ndarray) -> list[float]:
    """What the curve is fitted on."""
    own = w[found]
    top = np.sort(own)[-5:] if len(own) else own
    best = float(top[-1]) if len(top) else 0.0
    return [1.0, float(np.log1p(top.sum())), best, float(np.log1p((own > 1.5).sum())), float((own > 1.5).sum() / max(1, len(own)) ** 0.5)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, slightly held back."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        back = 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + back, x.T @ (y - p) - 1e-2 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, lm: np.ndarray, w: np.ndarray, beta: np.ndarray | None, share: float):
        self.lm, self.w, self.beta, self.share = lm, w, beta, share

    def score(self, features: Features, text: str) -> float:
        if self.beta is None:
            return self.share
        z = float(np.dot(evidence(features.of_text(text), self.w), self.beta))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> Model:
    """Fit on documents with labels that aren't held out."""
    lm = language_model([tuple(r) for r in trigram_counts(docs).collect()])  # at most SYMBOLS**3 rows
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("__id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    # the sample is bounded by `most`: a few bytes a row
    joined = docs.select(F.col("doc_id").cast("long").alias("__doc"), text_or_empty().alias("text")).join(F.broadcast(usable), F.col("__doc") == F.col("__id"))
    # folds: a document's evidence comes from features counted on the others
    sample = written(joined.select("text", "toxic", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample").repartition(max(1, min(64, n // 200)))
    by_label = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = lambda y, f=None: sum(k for (g, t), k in by_label.items() if t == y and g != f)
    toxic, clean = kind(1), kind(0)
    share = toxic / (toxic + clean) if toxic + clean else 0.0
    if not toxic or not clean:
        return Model(lm, np.zeros(BUCKETS, np.float32), None, share)
    got = feature_counts(sample, lm).toArrow()  # at most FOLDS * BUCKETS rows
    counts = np.zeros((FOLDS, 2, BUCKETS))
    fold, bucket = got["fold"].to_numpy(), got["bucket"].to_numpy()
    counts[fold, 1, bucket], counts[fold, 0, bucket] = got["toxic"].to_numpy(), got["clean"].to_numpy()
    w = weights(counts.sum(0), toxic, clean)
    others = [weights(counts.sum(0) - counts[f], kind(1, f), kind(0, f)) for f in range(FOLDS)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lm)
        for b in batches:
            x = [evidence(features.of_text(t), others[f])[1:] for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), *(pa.array([r[i] for r in x], pa.float64()) for i in range(4))], names=["toxic", "x1", "x2", "x3", "x4"])

    rows = np.asarray(sample.mapInArrow(seen, "toxic int, x1 double, x2 double, x3 double, x4 double").collect())
    rows = rows[np.lexsort(rows.T)]
    return Model(lm, w, fit(np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0]), share)


def score(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        features = Features(m.lm)
        for b in batches:
            got = [m.score(features, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def apply(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose text scores below the threshold, with all their columns."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        features = Features(m.lm)
        for b in batches:
            fine = [m.score(features, t or "") < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, schema)
