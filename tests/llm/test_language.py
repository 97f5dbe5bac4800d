"""Languages by held-out accuracy and against plain Python, and on awkward rows."""

import math
import random
import zlib

import numpy as np
import pytest

from rangeloom.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, rate string, n string"
WORDS = {"aa": "na ka ta la man kan tal".split(), "bb": "öl üx ßo öx lüs olß".split(), "cc": "日本 語文 本語 文日 語本".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows(n=240, seed=3):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(WORDS)), rng.randrange(1, 60)), lang if i % 7 else None, "s", "x", "y") for i in range(n)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def grams(t):
    """Letters and single spaces, with one at either end."""
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if n > 1 or s[i] != " "]


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_counts_are_of_the_ngrams(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    of = {}
    for t in ("a", "ab", "abc ab", "Ab, c!  d\n\nAB", "..a", "a..", "  ab  12 cd", "éÉ 日本", "a-b-c"):
        got = language.counts(t)
        assert got.sum() == len(grams(t)), t
        of[t] = got
    assert (of["a"] == language.counts("  A!! ")).all() and (of["..a"] == of["a.."]).all()
    assert language.counts(None) is None and language.counts("") is None and language.counts(" 12 €! ") is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert found.keys() == truth.keys()
    own = [i for i in truth if held(i)]
    assert all(found[i].held_out == held(i) for i in truth)
    assert sum(found[i].lang_pred == truth[i] for i in own) / len(own) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_against_plain_python(spark):
    """The vectors, their weights and the nearest centroid, from the model's centroids."""
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    learn = [r for r in data if not held(r[0]) and r[2]]
    model = language.fit(df)
    n, seen = 0, np.zeros(language.DIMENSIONS)
    for r in learn:
        n += 1
        seen += language.counts(r[1]) > 0
    assert np.allclose(model.idf, [math.log((1 + n) / (1 + k)) + 1 for k in seen])
    assert sorted(set(model.languages)) == sorted(WORDS) and all(model.languages.count(x) <= language.CENTROIDS for x in WORDS)
    assert np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-6)
    for r in language.predict(df, model).collect():
        c = language.counts(next(t for i, t, *_ in data if i == r.doc_id))
        v = [math.log1p(k) * w for k, w in zip(c, model.idf, strict=True)]
        size = math.sqrt(sum(x * x for x in v))
        cosines = [sum(x * y for x, y in zip(v, m, strict=True)) / size for m in model.centres.tolist()]
        best = cosines.index(max(cosines))
        assert r.lang_pred == model.languages[best] and r.centroid == model.numbers[best] and abs(r.score - min(1, max(cosines))) < 1e-9
        assert r.rejected == (1 - r.score > model.radii[best])


def test_held_out_rows_teach_nothing(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    other = spark.createDataFrame([(i, "zz zz", "dd", *x) if held(i) else (i, t, lang, *x) for i, t, lang, *x in data], SCHEMA)
    a, b = language.fit(df), language.fit(other)
    assert "dd" not in b.languages and a.languages == b.languages and (a.centres == b.centres).all() and (a.idf == b.idf).all()


def test_far_texts_are_rejected(spark):
    df = spark.createDataFrame([*rows(), (1000, "qqq www zzz " * 40, None, "s", "x", "y")], SCHEMA)
    found = {r.doc_id: r for r in language.identify(df).collect()}
    assert found[1000].rejected and found[1000].lang_pred in WORDS
    assert sum(r.rejected for i, r in found.items() if i < 1000) < 30


def test_clusters():
    rng = np.random.default_rng(1)
    x = np.vstack([np.eye(8)[k] + rng.normal(scale=0.01, size=(20, 8)) for k in (0, 3, 5)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, own = language.cluster(x, 3)
    assert len(centres) == 3 and all(len(set(own[i : i + 20])) == 1 for i in (0, 20, 40)) and len(set(own[::20])) == 3
    centres, own = language.cluster(np.repeat(x[:1], 5, 0), 4)  # copies of one row
    assert len(centres) == 1 and set(own) == {0}


AWKWARD = [(1, None, "aa"), (2, "", "aa"), (3, " 1!€ \n", "bb"), (None, "man kan", None), (None, None, None), (4, "man " * 30_000, "aa"), (5, "x", None), (6, "man kan", "aa"), (6, "man kan", "aa"), (7, "öl üx", "bb"), (8, "\x00\x01 a", ""), (9, "İΣΣ ß 😀", "bb")]


def test_awkward_rows(spark):
    df = spark.createDataFrame([(*r, "s", "x", "y") for r in AWKWARD], SCHEMA).repartition(3)
    got = language.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "centroid", "rejected"]
    found = got.collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in AWKWARD)
    for r in found:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score, r.centroid, r.rejected) == ("und", 0.0, None, True)
    assert {(r.lang_pred, r.score) for r in found if r.doc_id == 6} == {(next(r.lang_pred for r in found if r.doc_id == 6), next(r.score for r in found if r.doc_id == 6))}
    assert language.identify(df.limit(0)).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, "some words", None, "s", "x", "y") for i in range(4)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in language.identify(df).collect()} == {("und", 0.0)}


def test_a_hot_row_stands_in_the_sample_once(spark):
    df = spark.createDataFrame(rows() + [rows()[1]] * 500, SCHEMA)
    learn = df.where(~language.held_out() & df.lang.isNotNull()).select("doc_id", "text", "lang")
    members = sum(r.members for r in language.centroids(learn, np.ones(language.DIMENSIONS)).collect())
    assert members <= 240
