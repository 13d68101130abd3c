"""WARC output and a splittable WARC reader.

Each record is a gzip member of its own. Of records with equal payloads of at least `least` bytes that with the smallest
page_id holds the payload (response); the others only refer to it (revisit). Which is which comes from digests and ids alone,
by an aggregate that combines before its shuffle, so a payload that a third of all pages share is no single task's work.

The reader cuts files into byte ranges. A task looks for gzip magic in its range and takes a place for a member only if all of it inflates to
one WARC record: a version line, the fields that each record must have, and as many bytes as its Content-Length says. From there it goes on
from member to member and owns those that start inside its range. A range that starts inside a member may meet a whole archive in that member's
payload, so a record also counts only if no member of an earlier range of its file reaches over its start: one running maximum over a file's
ranges tells. What is read is thus what one reader from the file's start would read, whatever the size of ranges. Where a member should
follow and none does, a row of damage is kept (damage()), and reading goes on at the next member.

Defined results: a null html is an empty payload; a null url writes no target; a null page_id is never the smallest, and such a
record is a revisit if an id has the payload; rows that repeat the smallest id of their payload are all responses; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, prepare, shuffle_partitions, task_number, workdir
from .files import committed, file_size, make_dir

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _name(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _record(kind: str, page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def decided(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, payload) with digest and refers_to, null for a response."""
    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    chosen = chosen.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    small = chosen.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    again = small.join(first, "digest").where("page_id IS NULL OR page_id > first").distinct()
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return chosen.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_warc(pages: DataFrame, out: str, least: int = 100, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write pages as files of the folder out; a table of (uri, bytes), one row per file."""
    prepare(pages.sparkSession)
    make_dir(out)

    def write(batches):
        uri = f"{out}/part-{task_number():06d}.warc.gz"
        started = None
        try:
            for batch in batches:
                if batch.num_rows and started is None:
                    started = committed(uri)
                    stream = started.__enter__()
                    info = b"software: pliego\r\nformat: WARC File Format 1.1\r\n"
                    stream.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_name(uri.rsplit('/', 1)[1])}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level))
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    stream.write(_member(_record("response" if refers is None else "revisit", page, url, payload, digest, refers, date), level))
        except BaseException as e:
            if started:
                started.__exit__(type(e), e, e.__traceback__)
            raise
        if started:
            started.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"uri": uri, "bytes": file_size(uri)}])

    return materialize(decided(pages, least).mapInArrow(write, "uri string, bytes long"), "warc-files")[0]


class Members:
    """What starts in [start, end) of a gzip file: (place, next place, record) for members of WARC, (place, place, None) where a member should start and none does."""

    def __init__(self, stream, start: int, end: int):
        self.stream, self.start, self.end = stream, start, end
        self.base, self.buffer = start, b""

    def _have(self, at: int, n: int) -> memoryview:
        """What lies from `at` on: n bytes, or less at the file's end."""
        if at < self.base or at > self.base + len(self.buffer):
            self.base, self.buffer = at, b""
            self.stream.seek(at)
        if at - self.base > 1 << 20:
            self.buffer, self.base = self.buffer[at - self.base :], at
        while len(self.buffer) - (at - self.base) < n:
            self.stream.seek(self.base + len(self.buffer))
            if not (more := self.stream.read(BLOCK)):
                break
            self.buffer += more
        return memoryview(self.buffer)[at - self.base : at - self.base + n]

    def member(self, at: int):
        """(record, next place) of the member at `at`; None if there is none, or none of WARC."""
        if bytes(self._have(at, 3)) != MAGIC:
            return None
        d, parts, head, place = zlib.decompressobj(31), [], b"", at
        try:
            while not d.eof:
                data = self._have(place, BLOCK)
                if not len(data):
                    return None
                parts.append(d.decompress(data))
                place += len(data)
                if len(head) < 7:
                    head += parts[-1][:7]
                    if not b"WARC/1.".startswith(head[:7]):
                        return None
        except zlib.error:
            return None
        record = b"".join(parts)
        return (record, place - len(d.unused_data)) if whole(record) else None

    def __iter__(self):
        at, expected = self.start, self.start == 0
        while at < self.end or expected:
            if not len(self._have(at, 1)):
                return
            if found := self.member(at):
                if at >= self.end:  # only asked for as it should follow; the next range has it
                    return
                yield at, found[1], found[0]
                at, expected = found[1], True
                continue
            if expected:
                yield at, at, None
            if at >= self.end:
                return
            expected, data = False, bytes(self._have(at, BLOCK))  # the start of the range, or damage: look for the next member
            if len(data) < 3:
                return
            k = data.find(MAGIC, 1)
            at += k if k > 0 else len(data) - 2


#: The fields that a record must have (fixed values).
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def whole(record: bytes) -> bool:
    """Whether these bytes are one WARC record, no more and no less."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return False
    headers, _ = parse(record, with_block=False)
    size = headers.get("content-length", "")
    return all(headers.get(n) for n in NEEDED) and size.isdecimal() and len(rest) == int(size) + 4 and rest.endswith(b"\r\n\r\n")


def parse(record: bytes, with_block: bool = True) -> tuple[dict, bytes]:
    """Headers, by lower-case name, and the block of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")[1:]
    headers = {k.lower().strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])] if with_block else b""


def members(files: DataFrame, split_bytes: int, with_payload: bool) -> DataFrame:
    """(uri, range, place, end, the columns of RECORDS): one row per member and per place of damage that ranges of split_bytes meet; record_type damage for the latter."""
    spark = files.sparkSession
    prepare(spark)
    columns = "uri string, range long, place long, end long, " + RECORDS + ", payload binary" * with_payload
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.isdecimal() else None

    def told(record: bytes) -> tuple:
        h, block = parse(record)
        kind, clean = h["warc-type"], lambda t: t and t.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        size, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (number(h.get("x-payload-length")), clean(h.get("warc-payload-digest", "").partition(":")[2]) or None)
        return number(h.get("x-page-id")), clean(h.get("warc-target-uri")), clean(kind), number(h.get("x-refers-to-page")), size, digest, payload

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_file(path) as f:
                    for place, end, record in Members(f, start, start + split_bytes):
                        row = told(record) if record is not None else (None, None, "damage", None, None, None, None)
                        rows.append((uri, start, place, end, *row)[: len(names)])
                        size += len(record or b"")
                        if len(rows) >= 500 or size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ranges = files.select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    found, _ = materialize(ranges.repartition(shuffle_partitions(spark)).mapInArrow(read, columns), "warc-members")
    reach = found.groupBy("uri", "range").agg(F.max("end").alias("_end"))
    earlier = Window.partitionBy("uri").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    before = reach.select("uri", "range", F.coalesce(F.max("_end").over(earlier), F.lit(0)).alias("_before"))
    return found.join(before, ["uri", "range"]).where("place >= _before").drop("_before")


def read_warc(files: DataFrame, split_bytes: int = 32 << 20, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit in files (uri, bytes), in ranges of split_bytes. A revisit's size and digest are those of its headers, a response's are computed."""
    columns = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    return members(files, split_bytes, with_payload).where("record_type IN ('response', 'revisit')").select(*columns)


def damage(files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """(uri, place) of every place in files (uri, bytes) where a member should start and none does."""
    return members(files, split_bytes, False).where("record_type = 'damage'").select("uri", "place")


def archive(pages: DataFrame, least: int = 100, split_bytes: int = 32 << 20) -> DataFrame:
    """Write pages to a folder of the shared root and read the archives back."""
    return read_warc(write_warc(pages, workdir(pages.sparkSession, "warc"), least), split_bytes)
