"""Archives read by ranges and written at places, against the standard library's."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pliego.sources import zips


def rows(df):
    return {r.name: bytes(r.content) for r in df.collect()}


def made(seed=1, n=60):
    rng = random.Random(seed)
    return {f"páginas/{k:03}.bin": bytes(rng.choices(range(4), k=rng.choice([0, 1, 50, 5000]))) for k in range(n)}


def archive(path, files, method=zipfile.ZIP_DEFLATED, comment=b""):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("páginas/", b"")
        for n, d in files.items():
            z.writestr(n, d)
        z.comment = comment
    return f"file://{path}"


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_archives_are_read_entry_by_entry(spark, tmp_path, method):
    files = made()
    archive(tmp_path / "a.zip", files, method, b"PK\x05\x06 in a comment, not an end" * 3)
    archive(tmp_path / "b.zip", {"x": b"y"})
    got = zips.read_zips(spark, f"file://{tmp_path}/*.zip", task_bytes=5000)
    assert rows(got.where(F.col("path").endswith("a.zip"))) == files
    assert rows(got.where(F.col("path").endswith("b.zip"))) == {"x": b"y"}
    assert got.rdd.getNumPartitions() > 1


def test_limits_and_damage(spark, tmp_path):
    bomb = archive(tmp_path / "bomb.zip", {"zeros": bytes(1 << 20)})
    (entry,) = zips.directory(bomb)
    assert zips.content(bomb, *entry[:4], entry[5]) == bytes(1 << 20)
    with pytest.raises(ValueError, match="over"):
        zips.content(bomb, *entry[:4], entry[5], most=1000)
    lying = (tmp_path / "bomb.zip").read_bytes()
    at = lying.rfind(b"PK\x01\x02")
    (tmp_path / "lie.zip").write_bytes(lying[: at + 24] + struct.pack("<I", 10) + lying[at + 28 :])  # says ten bytes unpacked
    with pytest.raises(Exception, match="over"):
        zips.read_zips(spark, f"file://{tmp_path}/lie.zip", most=5000).collect()
    for name, data in {"no": b"nothing", "cut": lying[:-30], "directory": lying[:at] + b"XX" + lying[at + 2 :], "entry": lying[: entry[5]] + b"XX" + lying[entry[5] + 2 :], "crc": lying[: at + 16] + b"\0\0\0\0" + lying[at + 20 :]}.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
        with pytest.raises(Exception, match="no ZIP|damaged|no entry|beyond"):
            zips.read_zips(spark, f"file://{tmp_path}/{name}.zip").collect()


def test_wide_archives(tmp_path):
    """More entries than a short directory counts, and places beyond four gigabytes, of which the file has but holes."""
    many = {f"{k}": b"" for k in range(70_000)}
    uri = archive(tmp_path / "many.zip", many)
    assert [e[0] for e in zips.directory(uri)] == list(many)
    far = 5 << 30
    with open(tmp_path / "far.zip", "wb") as f:
        f.seek(far)
        f.write(zips._local_header(b"far", 3, 0x8C736521) + b"foo")
        start = f.tell()
        record = zips._central_header(b"far", 3, 0x8C736521, far)
        f.write(record + zips._end(1, len(record), start))
    uri = f"file://{tmp_path}/far.zip"
    (entry,) = zips.directory(uri)
    assert entry[5] == far and zips.content(uri, *entry[:4], entry[5]) == b"foo"
    with zipfile.ZipFile(tmp_path / "far.zip") as z:
        assert z.read("far") == b"foo"


@pytest.mark.parametrize("part", [64 << 20, 3000])
def test_archives_are_written_in_parts(spark, tmp_path, part):
    files = made(2)
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in files.items()] + [("null", None)], "name string, content binary").repartition(5)
    path = tmp_path / "out.zip"
    assert zips.write_zip(df, f"file:{path}" if part == 3000 else f"file://{path}", part) == len(files) + 1
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == sorted([*files, "null"])
        assert {n: z.read(n) for n in z.namelist()} == files | {"null": b""}
    assert rows(zips.read_zips(spark, f"file://{path}")) == files | {"null": b""}
    assert [p.name for p in tmp_path.iterdir()] == ["out.zip"]


def test_no_entries_and_a_failure_leave_no_half(spark, tmp_path):
    empty = spark.createDataFrame([], "name string, content binary")
    assert zips.write_zip(empty, f"file://{tmp_path}/e.zip") == 0
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "e.zip").read_bytes())).namelist() == []
    bad = spark.range(3).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        zips.write_zip(bad, f"file://{tmp_path}/bad.zip")
    assert [p.name for p in tmp_path.iterdir()] == ["e.zip"]
