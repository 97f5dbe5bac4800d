"""Columns of features and regions with the same names, and of other names than usual, against SQL."""

import duckdb
import pytest

from rangeloom.operators import coverage, overlap_counts, overlap_join, overlap_left, overlap_semi

#: Features that have columns named like the region's, and like those the join makes.
F_COLUMNS = "chrom string, start long, end long, qid long, qstart long, qend long, rest string, __q_x string, __code long, n long"
F_ROWS = [("c", 10, 20, 7, 500, 3, "f1", "u", 1, 1), ("c", 15, 40, 7, 0, 1, "f2", "v", 2, 2), ("c", 90, 95, 8, None, None, None, None, None, None), ("d", 1, 9, None, 1, 2, "f4", "w", 4, 4)]
Q_COLUMNS = "chrom string, qstart long, qend long, qid long, rest string, x string, a long, b long, kind string"
Q_ROWS = [("c", 0, 50, 1, "q1", "s", 1, 2, "k"), ("c", 12, 93, 2, "q2", "t", 3, 4, "l"), ("d", 20, 30, 3, "q3", None, None, None, None), ("e", 1, 5, 4, "q4", "z", 7, 8, "m")]
ON = "f.chrom = q.chrom AND f.start < q.qend AND f.end > q.qstart"


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(F_ROWS, F_COLUMNS), spark.createDataFrame(Q_ROWS, Q_COLUMNS)


def sql(text):
    con = duckdb.connect()
    for name, columns, rows in (("f", F_COLUMNS, F_ROWS), ("q", Q_COLUMNS, Q_ROWS)):
        con.sql(f"CREATE TABLE {name} (" + ", ".join(f'"{c.split()[0]}" {c.split()[1].replace("string", "varchar").replace("long", "bigint")}' for c in columns.split(", ")) + ")")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", [list(r) for r in rows])
    return sorted(con.sql(text).fetchall(), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


RENAMED = {"chrom": "seq", "start": "istart", "end": "iend"}
REGION_RENAMED = {"region_chrom": "contig", "region_start": "first", "region_end": "past"}


def renamed(sides):
    """Both sides with other names for their sequences and bounds."""
    f, q = sides
    return f.withColumnsRenamed(RENAMED), q.withColumnsRenamed({"chrom": "contig", "qstart": "first", "qend": "past"}), {**RENAMED, **REGION_RENAMED}


def test_pairs(sides):
    got = overlap_join(*sides)
    assert got.columns == [c.split()[0] for c in F_COLUMNS.split(", ")] + ["region_qstart", "region_qend", "region_qid", "region_rest", "x", "a", "b", "kind"]
    assert rows(got) == sql(f'SELECT f.*, q.qstart, q.qend, q.qid, q.rest, q.x, q.a, q.b, q.kind FROM f JOIN q ON {ON}')


@pytest.mark.parametrize("zeros", [False, True])
def test_counts(sides, zeros):
    want = sql(f"SELECT q.qid, count(f.chrom) FROM q {'LEFT' if zeros else ''} JOIN f ON {ON} GROUP BY q.qid")
    got = overlap_counts(*sides, zeros=zeros)
    assert got.columns == ["qid", "n"] and rows(got) == want
    f, q, names = renamed(sides)
    assert rows(overlap_counts(f, q, zeros=zeros, **names)) == want


@pytest.mark.parametrize("key", ["qid", "rest", "x", "kind", "a"])
def test_any_key(sides, key):
    assert rows(overlap_counts(*sides, key, zeros=True)) == sql(f"SELECT q.{key}, count(f.chrom) FROM q LEFT JOIN f ON {ON} GROUP BY q.{key}")


def test_coverage(sides):
    want = sql(f"SELECT q.qid, count(f.chrom), coalesce(sum(least(f.end, q.qend) - greatest(f.start, q.qstart)) FILTER (f.chrom IS NOT NULL), 0)::bigint FROM q LEFT JOIN f ON {ON} GROUP BY q.qid")
    got = coverage(*sides)
    assert got.columns == ["qid", "n", "bases"] and rows(got) == want and all(r.bases >= 0 for r in got.collect())
    f, q, names = renamed(sides)
    assert rows(coverage(f, q, **names)) == want


def test_left(sides):
    got = overlap_left(*sides)
    assert len(set(got.columns)) == len(got.columns)
    assert got.columns[:5] == ["chrom", "region_qstart", "region_qend", "region_qid", "region_rest"]
    want = sql(f"SELECT q.*, f.* EXCLUDE (chrom) FROM q LEFT JOIN f ON {ON}")
    assert rows(got) == want
    f, q, names = renamed(sides)
    own = overlap_left(f, q, **names)
    assert "seq" not in own.columns and rows(own) == want


def test_semi(sides):
    f, q, names = renamed(sides)
    for anti in (False, True):
        assert rows(overlap_semi(*sides, anti=anti)) == rows(overlap_semi(f, q, anti=anti, **names)) == sql(f"SELECT * FROM f WHERE {'NOT' * anti} EXISTS (SELECT 1 FROM q WHERE {ON})")


def test_a_key_named_like_a_figure(sides):
    with pytest.raises(ValueError, match="key"):
        overlap_counts(sides[0], sides[1].withColumnRenamed("qid", "n"), "n")
