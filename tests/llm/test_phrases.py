"""Collocations against brute force, with ranges, tables and pieces so small that every boundary is met."""

import re
from collections import Counter

import pytest

from rangeloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, rank string, n string"


def brute(rows, support=30, first=2000):
    """lang to rows rank, phrase, a, l, r, n, score."""
    f, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            own = f.setdefault(lang, Counter())
            for m in range(1, 5):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = {}
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in cand.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(100 * b >= 80 * a for q, b in cand.items() if inside(q)):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        found = [(i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:first])]
        if found:
            out[lang] = found
    return out


def mined(df, *args):
    out = {}
    for r in phrases.collocations(df, *args).collect():
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return {k: sorted(v) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y") for i, (lang, t) in enumerate(rows)], SCHEMA)


def some(n=120, seed=5):
    import random

    rng = random.Random(seed)
    words = "the the the of of a New new york City été x_1 -- don't".split()
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]
    return [(rng.choice(["en", "en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("per_task,piece,bits,remembered", [(1 << 19, 4 << 20, 24, 1 << 20), (3, 40, 12, 2), (40, 500, 13, 30)])
def test_against_brute_force(spark, per_task, piece, bits, remembered):
    """A table of 2^12 cells fills up, ranges of a few projections cut prefixes anywhere."""
    rows = some()
    assert mined(frame(spark, rows).repartition(5), 30, 2000, bits, piece, remembered, per_task, max(per_task, 3)) == brute(rows)


def test_cuts_covers_and_limits(spark):
    rows = some(60, 8) + [("en", "a b c d e. " * 40), ("en", "a b c. x b c. " * 12), ("fr", "ha ha ha ha ha ha " * 20)]
    df = frame(spark, rows)
    assert mined(df, 12) == brute(rows, 12) and mined(df, 12, 3) == brute(rows, 12, 3)


def test_awkward_rows(spark):
    rows = [("en", None), (None, None), ("en", ""), ("en", " \t .,;:!?\n\r\x0b\x0c"), (None, "ab cd " * 40), ("und", "ab cd. " * 40), ("en", "x" * 100_000), ("en", "\x00 \x1c\x85\u2028 " * 35), ("", "É É " * 30), ("de", "one two " * 29)]
    rows += [("en", "of the end. " * 10)] * 4
    df = frame(spark, rows)
    want = brute(rows)
    assert mined(df.repartition(3)) == want and "und" in want and "" in want and "de" not in want
    assert mined(df.limit(0)) == {} and mined(frame(spark, rows[:4])) == {}


def test_a_hot_prefix_is_walked_by_several_tasks(spark):
    rows = [("en", f"hot w{i % 50} v{i % 7}. " * 3) for i in range(900)]
    df = frame(spark, rows)
    counted = phrases.count(df).cache()
    bits = phrases.frequent_cells(counted.where("block IS NOT NULL").select("block", "cells"), 30)
    projected = phrases.project(df, bits)
    got = {(r.lang, tuple(r.words)): r.f for r in phrases.grow(projected, 30, 20).collect()}
    assert got["en", ("hot", "w0")] == 54 and got == {(k, p): a for k, p, a in _frequent(rows)}


def _frequent(rows):
    own = Counter()
    for _, t in rows:
        for piece in t.split("."):
            w = piece.split()
            for m in (2, 3, 4):
                own.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return [("en", p, a) for p, a in own.items() if a >= 30]


def test_large_counts_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 1 << 61
    found = spark.createDataFrame([("en", ["a", "b"], big), ("en", ["a", "b", "c"], big // 5 * 4), ("en", ["b", "c"], big // 5 * 4)], "lang string, words array<string>, f long")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 11), ("en", "c", big)], "lang string, word string, n long")
    got = {tuple(r.words): (r.score, r.l, r.r) for r in phrases.scored(found, words).collect()}
    assert got["a", "b"] == (2_000_000 * big // (2 * big + 18), big + 7, big + 11)
    assert got["a", "b", "c"][0] == min(2_000_000 * (big // 5 * 4) // (big + 7 + big // 5 * 4), 2_000_000 * (big // 5 * 4) // (2 * big))
    held = {tuple(r.words): r.held for r in phrases.covered(found).collect()}
    assert held == {("a", "b"): big // 5 * 4, ("b", "c"): big // 5 * 4}


def _rows_from_python(spark, texts):
    """How many rows the projection's Python makes, a task for each text, and how many places they stand for."""
    df = spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in enumerate(texts)], SCHEMA).repartitionByRange(len(texts), "doc_id")
    bits = phrases.frequent_cells(phrases.count(df).where("block IS NOT NULL").select("block", "cells"), 30)
    found = phrases.project(df, bits)
    made = found._jdf.queryExecution().analyzed().child()  # what the aggregate gets
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, made).count(), sum(r.n for r in found.collect())


def test_projections_grow_with_the_places_of_frequent_pairs(spark):
    """Of five times the text, tasks alike: many more pairs reach the support, but a place is one row."""
    text = "".join("hot pair. " * 2000) + "".join(f"w{i} v{i}. " * 10 for i in range(200))
    (few, few_places), (many, many_places) = (_rows_from_python(spark, [text] * k) for k in (1, 5))
    assert (few_places, many_places) == (2000, 20_000)
    assert many < 12 * few


def test_cells_grow_with_the_text(spark, monkeypatch):
    """However much text, few cells fill, so that places of infrequent phrases are no projections; cells are sent many times, in several blocks."""
    monkeypatch.setattr(phrases, "CELL_BITS", 8)
    monkeypatch.setattr(phrases, "PLACES", 500)
    rows = [("en", " ".join(f"w{i * 7 % 300} v{(i * i + k) % 300}" for i in range(400))) for k in range(60)] + [("en", "of the end " * 20)] * 4
    seen, project = [], phrases.project
    monkeypatch.setattr(phrases, "project", lambda docs, frequent, *args: seen.append((frequent, found := project(docs, frequent, *args))) or found)
    assert mined(frame(spark, rows)) == brute(rows)
    (frequent, projected), words = seen[0], sum(len(t.split()) for _, t in rows)
    assert frequent.shape[1] * 8 == 1 << phrases.cell_bits(sum(len(t) for _, t in rows)) > words / 20
    assert projected.agg({"n": "sum"}).first()[0] < words / 4
    assert mined(frame(spark, rows), 30, 2000, 19) == brute(rows)
    assert (phrases.cell_bits(0), phrases.cell_bits(10 << 30), phrases.cell_bits(1 << 40)) == (8, 28, 28)
