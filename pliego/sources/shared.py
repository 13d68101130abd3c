"""Working folders that all executors share, and small facts of file systems."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in executors' Python workers."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="pliego-")) / "pliego_library.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)


@cache
def _local_root(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='pliego-shared-')}"


def root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where none is set and all work is in one process, a temporary folder of that process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return _local_root(spark.sparkContext.applicationId)


def workdir(spark: SparkSession, tag: str) -> str:
    """A new folder's name under root; the folder goes when the driver ends."""
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, name: str) -> None:
    try:
        path, system = _path(spark, name)
        system.delete(path, True)
    except Exception:  # the session may have ended before its folders go
        pass


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _path(spark, name)
    return system.exists(path)


def children(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    path, system = _path(spark, name)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether the folder old became new; a new name that is taken stays as it is. File systems move a folder into one that came between: then it is taken out again."""
    path, system = _path(spark, old)
    to, _ = _path(spark, new)
    if system.exists(to) or not system.rename(path, to):
        return False
    inside, _ = _path(spark, f"{new}/{path.getName()}")
    if system.exists(inside):
        system.delete(inside, True)
        return False
    return True


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in a working folder: its lineage ends there."""
    path = workdir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
