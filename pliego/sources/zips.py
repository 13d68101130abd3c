"""ZIP archives in parts: read by ranges, entry by entry, and written by many tasks at once.

Reading: of each archive only the tail and the central directory are read at first, which gives a row an entry; entries are then dealt to tasks by their size, each of which reads its entry's
range and inflates it piece by piece, up to a limit that the directory's claims don't change. So an archive of any size is many tasks' work.

Writing: entries lie one after the other in order of name, so an entry's place is a prefix sum of sizes, first of ranges of names, then within them. Each task writes its entries, and
their lines of the directory, where they belong in one file, under another name until all is there; a task that runs again writes the same bytes. The file system must
allow writing at places of a file, as local and mounted ones do.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Signatures and sizes of the format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE, LONGEST_COMMENT = 30, 46, 22, 56, 20, 65_535
FULL = 0xFFFFFFFF
#: Of an entry unpacked, at most.
MOST_BYTES = 300 << 20
DIRECTORY = "path string, name string, method int, crc long, packed long, unpacked long, offset long"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return system.open_input_file(path)


def directory(uri: str) -> list[tuple]:
    """(name, method, crc, packed, unpacked, offset) of an archive's entries, from its tail and central directory alone. What isn't an archive is an error."""
    with _open(uri) as f:
        size = f.size()
        tail_at = max(0, size - END_SIZE - LONGEST_COMMENT - LOCATOR64_SIZE)
        f.seek(tail_at)
        tail = f.read(size - tail_at)
        # A comment may hold the signature: the end is where the comment's length fits.
        end = tail.rfind(END)
        while end >= 0 and (len(tail) - end < END_SIZE or END_SIZE + struct.unpack("<20xH", tail[end : end + END_SIZE])[0] != len(tail) - end):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError(f"{uri}: no ZIP archive")
        n, length, start = struct.unpack("<10xHII", tail[end : end + 20])
        if n == 0xFFFF or FULL in (length, start):
            where = tail[max(0, end - LOCATOR64_SIZE) : end]
            if where[:4] != LOCATOR64:
                raise ValueError(f"{uri}: no ZIP64 directory")
            f.seek(struct.unpack("<8xQ", where[:16])[0])
            record = f.read(END64_SIZE)
            if record[:4] != END64:
                raise ValueError(f"{uri}: no ZIP64 directory")
            n, length, start = struct.unpack("<32xQQQ", record)
        if start + length > size:
            raise ValueError(f"{uri}: its directory is beyond its end")
        f.seek(start)
        raw = f.read(length)
    out, at = [], 0
    for _ in range(n):
        if raw[at : at + 4] != CENTRAL or len(raw) - at < CENTRAL_SIZE:
            raise ValueError(f"{uri}: a damaged directory")
        flags, method, crc, packed, unpacked, a, b, c, offset = struct.unpack("<8xHH4xIIIHHH8xI", raw[at : at + CENTRAL_SIZE])
        name, extra = raw[at + CENTRAL_SIZE : at + CENTRAL_SIZE + a], raw[at + CENTRAL_SIZE + a : at + CENTRAL_SIZE + a + b]
        while len(extra) >= 4:
            kind, m = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the numbers that are full, in this order
                wide = iter(struct.unpack(f"<{m // 8}Q", extra[4 : 4 + m // 8 * 8]))
                unpacked, packed, offset = (next(wide, x) if x == FULL else x for x in (unpacked, packed, offset))
            extra = extra[4 + m :]
        at += CENTRAL_SIZE + a + b + c
        text = name.decode("utf-8" if flags & 0x800 else "cp437")
        if not text.endswith("/"):
            out.append((text, method, crc, packed, unpacked, offset))
    return out


def content(uri: str, name: str, method: int, crc: int, packed: int, offset: int, most: int = MOST_BYTES) -> bytes:
    """An entry, unpacked in pieces: never more than `most` bytes, whatever the directory says."""
    if method not in (0, 8):
        raise ValueError(f"{name}: compression method {method}")
    with _open(uri) as f:
        f.seek(offset)
        head = f.read(LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no entry at its place")
        f.seek(offset + LOCAL_SIZE + sum(struct.unpack("<26xHH", head)))
        out, size, left, inflate = [], 0, packed, zlib.decompressobj(-15)
        while left > 0:
            raw = f.read(min(left, 1 << 20))
            if not raw:
                raise ValueError(f"{name}: cut short")
            left -= len(raw)
            while raw:
                piece, raw = (raw, b"") if method == 0 else (inflate.decompress(raw, 1 << 20), inflate.unconsumed_tail)
                size += len(piece)
                if size > most:
                    raise ValueError(f"{name}: over {most} bytes")
                out.append(piece)
    data = b"".join(out)
    if zlib.crc32(data) != crc:
        raise ValueError(f"{name}: damaged")
    return data


def read_zips(spark: SparkSession, paths: list[str] | str, most: int = MOST_BYTES, task_bytes: int = 64 << 20) -> DataFrame:
    """(path, name, content): a row for each entry of the archives (globs are welcome)."""

    def list_(batches):
        for batch in batches:
            rows = [(uri, *e) for uri in batch.column(0).to_pylist() for e in directory(uri)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], [x.split()[0] for x in DIRECTORY.split(", ")])

    def unpack(batches):
        for batch in batches:
            for uri, name, method, crc, packed, _, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([name]), pa.array([content(uri, name, method, crc, packed, offset, most)], pa.binary())], ["path", "name", "content"])

    shared.ship(spark)
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    listed = shared.written(files.repartition("path").mapInArrow(list_, DIRECTORY), "directory")
    parts = max(1, -(-(listed.agg(F.sum(F.col("packed") + 4096)).first()[0] or 0) // task_bytes))
    return listed.repartition(parts, "path", "offset").mapInArrow(unpack, "path string, name string, content binary")


def _local_header(name: bytes, size: int, crc: int) -> bytes:
    return LOCAL + struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 0x21, crc, size, size, len(name), 0) + name


def _central_header(name: bytes, size: int, crc: int, offset: int) -> bytes:
    extra = struct.pack("<HHQ", 1, 8, offset) if offset >= FULL else b""
    return CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if extra else 20, 0x800, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, min(offset, FULL)) + name + extra


def _end(n: int, length: int, start: int) -> bytes:
    wide = b""
    if n >= 0xFFFF or start + length >= FULL:
        wide = END64 + struct.pack("<QHHIIQQQQ", END64_SIZE - 12, 45, 45, 0, 0, n, n, length, start)
        wide += LOCATOR64 + struct.pack("<IQI", 0, start + length, 1)
    return wide + END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, FULL), min(start, FULL), 0)


def placed(entries: DataFrame, parts: int) -> DataFrame:
    """entries (name, content) with crc, and where each and its line of the directory begin, the directory counted from its own start."""
    e = entries.select("name", "content").repartitionByRange(parts, "name").sortWithinPartitions("name")
    e = shared.written(e.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth"), F.crc32("content").alias("crc"), F.octet_length("content").cast("long").alias("size")), "entries")
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)

    def summed(rows: DataFrame, length, name: str) -> DataFrame:
        """rows with the sum of a length over all before: of parts, of which there are few, then within their own."""
        sums = rows.groupBy("part").agg(F.sum(length).alias("_sum"))
        base = sums.select(F.col("part").alias("_part"), (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_base"))
        out = rows.withColumn(name, F.coalesce(F.sum(length).over(within), F.lit(0))).join(F.broadcast(base), F.col("part") == F.col("_part"))
        return out.withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")

    named = F.octet_length("name")
    sizes = shared.written(summed(e.drop("content"), LOCAL_SIZE + named + F.col("size"), "offset"), "offsets")
    lines = summed(sizes, CENTRAL_SIZE + named + F.when(F.col("offset") >= FULL, 12).otherwise(0), "line").select("nth", "offset", "line")
    return e.join(lines, "nth")


def write_zip(entries: DataFrame, path: str, part_bytes: int = 64 << 20) -> int:
    """entries (name, content) as one archive of stored entries, in order of name; returns how many there are. A null content is empty."""
    shared.ship(entries.sparkSession)
    entries = entries.select("name", F.coalesce("content", F.lit(b"")).alias("content"))
    total = entries.agg(F.count("*").alias("n"), F.sum(F.octet_length("content") + F.octet_length("name") + LOCAL_SIZE).alias("b")).first()
    n, start, local = total.n, int(total.b or 0), re.sub("^file:/+", "/", path)
    part = f"{local}.{uuid.uuid4().hex}.part"
    os.close(os.open(part, os.O_CREAT | os.O_EXCL | os.O_WRONLY))

    def put(batches):
        done = 0
        with open(part, "r+b") as f:
            for batch in batches:
                for name, data, crc, size, offset, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = name.encode()
                    f.seek(offset)
                    f.write(_local_header(raw, size, crc) + data)
                    f.seek(start + line)
                    record = _central_header(raw, size, crc, offset)
                    f.write(record)
                    done += len(record)
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["bytes"])

    try:
        rows = placed(entries, max(1, -(-start // part_bytes))).select("name", "content", "crc", "size", "offset", "line")
        length = int(rows.mapInArrow(put, "bytes long").agg(F.sum("bytes")).first()[0] or 0)
        with open(part, "r+b") as f:
            f.seek(start + length)
            f.write(_end(n, length, start))
        os.replace(part, local)
    except BaseException:
        os.unlink(part)
        raise
    return n
