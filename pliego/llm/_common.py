"""What the operators share: shipping the package, shared working folders, packed chunks of documents."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: what lies between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Order key of a document without an id: after all others. So the largest of all longs can't be an id; where it is one, it counts as none.
NO_ID = np.iinfo(np.int64).max

_shipped: dict[str, bool] = {}


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and keep Arrow batches small, as one text may be very long."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="pliego-")) / "pliego_package.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped[app] = True
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a temporary folder becomes it, if all work is in one process; else that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='pliego-shared-')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def workdir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared root; it is removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/pliego-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working folder whose content nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before its folders go
        pass


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and the table's path: this cuts the lineage."""
    spark = df.sparkSession
    path = workdir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files whose data frames are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names, whatever else docs holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


CHUNKS = "chunk_id long, doc_ids binary, lengths binary, body binary, rest binary"


def task_number() -> int:
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def pack_chunks(docs: DataFrame, chunk_bytes: int, carry: tuple[str, ...] = (), level: int = 1) -> DataFrame:
    """Documents packed into chunks of about chunk_bytes of UTF-8: ids and lengths as int64, the texts joined and compressed.

    A chunk holds whole documents, so one longer than chunk_bytes makes a larger chunk. A null text counts as empty; a
    null id is stored as NO_ID. rest holds the columns in carry, as an Arrow stream. Nothing is shuffled: each task packs what it
    reads.
    """

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=level)
        ids, texts, rest, size, made = [], [], [], 0, 0
        base = task_number() << 32

        def out():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made], pa.int64()),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                    pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                    pa.array([press.compress(b"".join(texts))], pa.binary()),
                    pa.array([_stream(rest) if carry else None], pa.binary()),
                ],
                ["chunk_id", "doc_ids", "lengths", "body", "rest"],
            )

        for batch in batches:
            start, others = 0, batch.select(list(range(2, batch.num_columns)))
            for at, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                t = (t or "").encode("utf-8", "surrogatepass")
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size += len(t)
                if size >= chunk_bytes:
                    rest.append(others.slice(start, at + 1 - start))
                    yield out()
                    ids, texts, rest, size, made, start = [], [], [], 0, made + 1, at + 1
            if start < batch.num_rows:
                rest.append(others.slice(start))
        if ids:
            yield out()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in carry])
    return chosen.mapInArrow(pack, CHUNKS)


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def carried(rest: bytes) -> pa.Table:
    """The columns that a chunk carries, in its documents' order."""
    return pa.ipc.open_stream(rest).read_all()


def unpack_chunk(doc_ids: bytes, lengths: bytes, body: bytes, rest: bytes | None = None) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, offsets (one more than documents) and the joined texts of a chunk."""
    import zstandard

    ids, n = np.frombuffer(doc_ids, "<i8"), np.frombuffer(lengths, "<i8")
    text = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(n.sum())))
    return ids, np.concatenate([[0], np.cumsum(n)]).astype(np.int64), text


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


#: Emptied when a worker turns to another operator's tasks.
WORKER_CACHES: list[dict] = []


def fresh_worker() -> None:
    """Give back what earlier tasks of other operators left in this Python worker, which Spark uses again and again."""
    import ctypes
    import gc

    if any(WORKER_CACHES):
        for cache in WORKER_CACHES:
            cache.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def unsigned_crc32(column) -> "F.Column":
    return F.crc32(column.cast("string").cast("binary"))
