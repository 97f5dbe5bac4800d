"""Block gzip against Python's gzip, with splits so small that they cut members and lines anywhere."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.sources import bed, bgzf, pack, read_bed_sniffed, write_tsv


def written(path, text, sizes, end=True):
    data, rng, at = b"", random.Random(3), 0
    while at < len(text):
        n = rng.choice(sizes)
        data += bgzf.deflate(text[at : at + n])
        at += n
    path.write_bytes(data + (bgzf._END if end else b""))
    return str(path)


def listed(spark, *paths):
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


TEXTS = {
    "lines": b"".join(b"chr1\t%d\t%d\tx%d\n" % (i, i + 5, i * 7919) for i in range(700)),
    "no end": b"a\nb\n\n\nc" * 40 + b"last",
    "long": b"x" * 5000 + b"\n" + b"y" * 9000 + b"\nz\n",
    "one": b"only",
    "blank": b"\n\n\n",
    "utf8": "é日本\tü\n".encode() * 200,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("split", [97, 1000, 1 << 25])
def test_splits(spark, tmp_path, name, split):
    text = TEXTS[name]
    path = written(tmp_path / "a", text, [1, 40, 300, 2000] if len(text) > 500 else [1, 3, 8], end=name != "long")
    assert gzip.open(path).read() == text
    want = text.decode().split("\n")
    if want[-1] == "":
        want = want[:-1]
    got = sorted(r.value for r in bgzf.read_lines(spark, listed(spark, path), split).collect())
    assert got == sorted(want)


def test_several_tasks_read_one_file(spark, tmp_path):
    path = written(tmp_path / "a.bed.gz", TEXTS["lines"] * 20, [4000])
    df = bgzf.read_lines(spark, listed(spark, path), 4000)
    assert df.rdd.getNumPartitions() > 5 and df.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert df.count() == 14_000


def test_members_that_only_look_like_some(spark, tmp_path):
    """Stored (uncompressed) members whose text holds headers."""
    import struct
    import zlib

    fake = bgzf.deflate(b"fake\n") * 3 + bgzf._END + bgzf._MAGIC * 50
    text = (fake.replace(b"\n", b"?") + b"\n") * 30
    data = b""
    for i in range(0, len(text), 900):
        part = text[i : i + 900]
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        data += bgzf._MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", 18 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(part), len(part))
    path = tmp_path / "a"
    path.write_bytes(data + bgzf._END)
    want = sorted(text.decode("utf-8", "replace").split("\n")[:-1])
    for split in (150, 5000, 1 << 20):
        assert sorted(r.value for r in bgzf.read_lines(spark, listed(spark, str(path)), split).collect()) == want


def test_broken_files_fail(spark, tmp_path):
    good = written(tmp_path / "good", TEXTS["lines"], [500])
    data = open(good, "rb").read()
    (tmp_path / "cut").write_bytes(data[:-40])
    (tmp_path / "changed").write_bytes(data[:5000] + bytes([data[5000] ^ 255]) + data[5001:])
    for name in ("cut", "changed"):
        for split in (700, 1 << 20):
            with pytest.raises(Exception, match="member|inflate|invalid|decompress|Error"):
                bgzf.read_lines(spark, listed(spark, str(tmp_path / name)), split).collect()


def test_kinds_of_files_together(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i: b"chr%d\t%d\t%d\trest\n" % (i % 3, i, i + 9)
    written(folder / "blocks.gz", b"".join(map(line, range(100))), [70])
    written(folder / "blocks.txt", b"".join(map(line, range(100, 150))), [70])
    (folder / "one.gz").write_bytes(gzip.compress(b"".join(map(line, range(150, 200)))))
    (folder / "odd").write_bytes(gzip.compress(b"".join(map(line, range(200, 250)))) + gzip.compress(b"".join(map(line, range(250, 260)))))
    (folder / "plain").write_bytes(b"".join(map(line, range(260, 300))))
    got = read_bed_sniffed(spark, str(folder), split=500)
    assert sorted(r.start for r in got.collect()) == list(range(300))


def test_write_and_read(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('chr', id % 4) AS chrom", "id AS start", "id + 3 AS end", "repeat('é', CAST(id % 90 AS int)) AS rest").repartition(3)
    path = str(tmp_path / "out.bgz")
    write_tsv(rows, path)
    assert sorted(bed.read_bed_sniffed(spark, path, split=2000).collect()) == sorted(rows.collect())
    files = sorted((tmp_path / "out.bgz").glob("*"))
    assert [f.name for f in files] == [f"part-0000{i}.bed.gz" for i in range(3)]
    assert sum(len(gzip.open(f).read().splitlines()) for f in files) == 3000
    with pytest.raises(FileExistsError):
        write_tsv(rows, path)
    write_tsv(rows.limit(5), path, mode="overwrite")
    assert bed.read_bed_sniffed(spark, path).count() == 5
    write_tsv(rows, path, mode="overwrite", ordered=True)
    assert pack(spark, path, str(tmp_path / "s")).count() == 3000
