"""Token-id output: flat files of unsigned integers and 64-bit document offsets, read back memory-mapped.

Layout of a folder: `manifest.json` lists the parts in ascending doc_id order with their token bases, which are the
prefix sums of the parts' token counts. Part N is three little-endian files: `N.tokens` (uint16 for vocabularies up to
65,536 ids, else uint32), `N.offsets` (uint64, one more than documents, relative to the part's base) and `N.docs` (int64
document ids). Documents are range-partitioned and sorted by doc_id, into as many parts as `part_bytes` of text make, so a part doesn't grow with
the table; a part is written by one task, under another name until it is whole, so a task that is run again replaces nothing by half. Reading takes a
range of a part's documents at a time.

Defined results: a null text is an empty document (the end id alone); null ids come first; rows that share an id keep
all their copies, ordered by text; an empty table makes no part. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NO_ID, doc_columns, id_column, prepare, shuffle_partitions, task_number, workdir
from .encoding import shared_encoder
from .files import committed, make_dir, numbers


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int, keep_space: bool = True, parts: int | None = None, part_bytes: int = 64 << 20) -> dict:
    """Write docs to the folder `out` and return its manifest. parts: how many, from the texts' bytes by default, but no fewer than shuffle partitions."""
    spark = docs.sparkSession
    prepare(spark)
    make_dir(out)

    def write(batches):
        part, encoder, end = task_number(), None, None
        ids, ends, total, stream, closer = array("q"), array("Q", [0]), 0, None, None  # 16 bytes a document
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if encoder is None:
                    encoder = shared_encoder(tokenizer, keep_space)
                    end = np.array([end_id], encoder.dtype).tobytes()
                    closer = committed(f"{out}/{part}.tokens")
                    stream = closer.__enter__()
                for tokens in encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                    stream.write(tokens.tobytes() + end)
                    total += len(tokens) + 1
                    ends.append(total)
                ids.extend(NO_ID if i is None else i for i in batch.column(0).to_pylist())
        except BaseException as e:
            if closer:
                closer.__exit__(type(e), e, e.__traceback__)
            raise
        if closer:
            closer.__exit__(None, None, None)
            for kind, values in (("offsets", ends), ("docs", ids)):
                with committed(f"{out}/{part}.{kind}") as f:
                    f.write(values.tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "docs": len(ids), "tokens": total, "dtype": encoder.dtype}])

    if not (n := parts):
        size = doc_columns(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(shuffle_partitions(spark), -(-size // part_bytes))
    ranged = doc_columns(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # One row for each part, however many documents: the manifest of a folder.
    rows = sorted(ranged.mapInArrow(write, "part long, docs long, tokens long, dtype string").collect())
    base, listed = 0, []
    for r in rows:
        listed.append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "base": base, "dtype": r.dtype})
        base += r.tokens
    manifest = {"tokens": base, "parts": listed, "end_id": end_id}
    with committed(f"{out}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, manifest: dict, with_ids: bool = False) -> DataFrame:
    """One row per document of a folder: doc_id, start, n_tokens, ids_crc32, and with_ids its ids as little-endian bytes."""
    prepare(spark)
    parts = manifest["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = parts[k]
                uri = f"{folder}/{p['part']}"
                for a in range(0, p["docs"], 500):
                    n = min(500, p["docs"] - a)
                    ids, ends = np.array(numbers(f"{uri}.docs", "<i8", a, n)), numbers(f"{uri}.offsets", "<u8", a, n + 1).astype(np.int64)
                    tokens = numbers(f"{uri}.tokens", p["dtype"], int(ends[0]), int(ends[-1] - ends[0]))
                    e = ends - ends[0]
                    raw = [tokens[i:j].astype("<u4").tobytes() for i, j in zip(e[:-1], e[1:], strict=True)]
                    columns = [id_column(ids), pa.array(ends[:-1] + p["base"]), pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    if not parts:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool = True) -> DataFrame:
    """Write docs to a folder of the shared root and read it back."""
    out = workdir(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, out, tokenizer, end_id, keep_space)
    return read_token_files(docs.sparkSession, out, manifest)
