"""A table kept as a log of sorted runs by key: edits write their own rows, lookups read few files, compaction merges runs.

A run is a folder of Parquet files, one folder for each bucket of hashed keys, sorted by key, with Bloom filters on the key. A version is a small table that names the runs
that count and, for each bucket, file range and order: (run, level, number, bucket, low, high, rows). Versions are only added, each under the next number by a rename that fails where the
number is taken, so writers that meet try again on top of the other, and a reader keeps the runs of the version that it opened: nothing is
overwritten, and `vacuum` removes only what no version since the given one names.

Of a key's rows the one of the run with the highest number counts; a row can say that its key is gone. A lookup asks the version for the runs whose bucket has the key in its
range, and reads these buckets only. An index by another column is such a log too, from (value, key) to nothing; its
entries are hints that a lookup verifies, as rows that have changed leave theirs behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

NUMBER, GONE, BUCKET = "_number", "_gone", "_bucket"


class KeyLog:
    """key: the column that rows are told apart by; a null is a key like others. schema: of rows. indexed: columns that have an index."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", buckets: int = 16, indexed: tuple[str, ...] = ()):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        kind = {f.name: f.dataType.simpleString() for f in self.schema}
        self.indexes = {c: KeyLog(spark, f"{root}/index-{c}", f"value {kind[c]}, key {kind[key]}", "value", buckets) for c in indexed}
        for x in self.indexes.values():
            x.by = ("value", "key")
        self.by: tuple[str, ...] = (key,)
        self.kind = kind[key]

    # Versions

    def version(self) -> int:
        """The newest; 0 before the first."""
        names = [n for n in shared.children(self.spark, f"{self.root}/versions") if n.isdigit()]
        return max(map(int, names), default=0)

    def _lines(self, version: int) -> DataFrame:
        """The runs of a version; and for each writer with numbered batches (tag) a line with the last number that it wrote."""
        schema = f"run string, level int, number long, bucket int, low {self.kind}, high {self.kind}, nulls boolean, rows long, tag string"
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/versions/{version}")

    def _runs(self, version: int) -> DataFrame:
        return self._lines(version).where("tag IS NULL").drop("tag")

    def done(self, tag: str, version: int | None = None) -> int:
        """The last batch that a writer committed; -1 before the first."""
        lines = self._lines(self.version() if version is None else version).where(F.col("tag") == tag)
        found = lines.agg(F.max("number")).first()[0]
        return -1 if found is None else found

    def _commit(self, make, batch: tuple[str, int] | None = None) -> int:
        """Adds the version that make(runs of the newest) gives; again if another came between. None from make adds nothing, nor does a batch that is in already."""
        while True:
            now = self.version()
            new = make(self._runs(now)) if batch is None or self.done(batch[0], now) < batch[1] else None
            if new is None:
                return now
            tags = self._lines(now).where("tag IS NOT NULL")
            if batch is not None:
                one = self._lines(0).schema
                told = self.spark.createDataFrame([(None, None, batch[1], None, None, None, None, None, batch[0])], one)
                tags = tags.where(F.col("tag") != batch[0]).unionByName(told)
            new = new.withColumn("tag", F.lit(None).cast("string")).unionByName(tags)
            part = f"{self.root}/versions/_{uuid.uuid4().hex}"
            new.coalesce(1).write.parquet(part)
            if shared.rename(self.spark, part, f"{self.root}/versions/{now + 1}"):
                return now + 1
            shared.remove(self.spark, part)

    # Runs

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.kind)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, level: int) -> tuple[str, DataFrame]:
        """A run of rows (with NUMBER and GONE), and its lines for a version, without a number."""
        run = f"run-{uuid.uuid4().hex}"
        out = rows.withColumn(BUCKET, self.bucket(F.col(self.key))).repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *self.by)
        out.write.partitionBy(BUCKET).option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.root}/{run}")
        if not any(n.startswith(BUCKET) for n in shared.children(self.spark, f"{self.root}/{run}")):
            return run, self._runs(0)
        written = self.spark.read.schema(out.schema).parquet(f"{self.root}/{run}")
        key = F.col(self.key)
        lines = written.groupBy(F.col(BUCKET).cast("int").alias("bucket")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.bool_or(key.isNull()).alias("nulls"), F.count("*").alias("rows"))
        return run, lines.select(F.lit(run).alias("run"), F.lit(level).alias("level"), F.lit(0).cast("long").alias("number"), "bucket", "low", "high", "nulls", "rows")

    def write(self, rows: DataFrame | None = None, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """Upserts rows, and removes the keys of gone (one column of the key's name); of a key in both the row stays. Of rows that share a key one stays, the greatest. Returns the version.

        batch: a writer's name and its batch's number: a batch that is written again, or one before it, changes nothing.
        """
        if batch is not None and self.done(batch[0]) >= batch[1]:
            return self.version()
        names = [f.name for f in self.schema]
        parts = []
        if gone is not None:
            marks = gone.select(*[F.col(n).cast(self.schema[n].dataType).alias(n) if n in self.by else F.lit(None).cast(self.schema[n].dataType).alias(n) for n in names])
            parts.append(marks.withColumn(GONE, F.lit(True)))
        if rows is not None:
            parts.append(rows.select(*[F.col(n).cast(self.schema[n].dataType).alias(n) for n in names]).withColumn(GONE, F.lit(False)))
        together = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        order = F.struct(~F.col(GONE), *[F.col(n) for n in names])
        one = together.groupBy(*self.by).agg(F.max_by(F.struct(*names, GONE), order).alias("r")).select("r.*").withColumn(NUMBER, F.lit(0).cast("long"))
        for column, index in self.indexes.items():  # before the rows, so that a reader of the rows finds their entries
            if rows is not None:
                index.write(rows.select(F.col(column).alias("value"), F.col(self.key).alias("key")))
        run, lines = self._write(one, 0)
        lines = shared.written(lines, "lines")

        def add(runs: DataFrame) -> DataFrame:
            number = (runs.agg(F.max("number")).first()[0] or 0) + 1
            return runs.unionByName(lines.withColumn("number", F.lit(number).cast("long")))

        return self._commit(add, batch)

    def _read(self, runs: list, where: Column | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of runs [(run, number)], each with its run's number."""
        from pyspark.sql import types as T

        schema = T.StructType([*self.schema, T.StructField(GONE, T.BooleanType()), T.StructField(NUMBER, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        out = self.spark.createDataFrame([], schema)
        for run, number in runs:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{run}")
            if buckets is not None:
                rows = rows.where(F.col(BUCKET).isin(buckets))
            rows = rows if where is None else rows.where(where)
            # A merged run keeps its rows' numbers; another's rows have their run's.
            out = out.unionByName(rows.withColumn(NUMBER, F.when(F.col(NUMBER) > 0, F.col(NUMBER)).otherwise(F.lit(number).cast("long"))))
        return out

    def _newest(self, rows: DataFrame, keep_marks: bool = False) -> DataFrame:
        names = [f.name for f in self.schema]
        carried = [*names, GONE, NUMBER]
        last = rows.groupBy(*self.by).agg(F.max_by(F.struct(*carried), NUMBER).alias("r")).select("r.*")
        return last.select(*carried) if keep_marks else last.where(~F.col(GONE)).select(*names)

    def _named(self, version: int | None) -> list:
        runs = self._runs(self.version() if version is None else version)
        return [(r.run, r.number) for r in runs.select("run", "number").distinct().collect()]  # as few as compaction leaves

    def scan(self, version: int | None = None) -> DataFrame:
        """The whole table, as of a version, the newest by default."""
        return self._newest(self._read(self._named(version)))

    def lookup(self, value, version: int | None = None) -> DataFrame:
        """The row of a key; for an index's log, the entries of a value."""
        return self._newest(self._found([value], version))

    def _found(self, values: list, version: int | None) -> DataFrame:
        """Rows of the given keys, from the runs and buckets whose range holds one of them."""
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(self.kind) for v in values])).alias("_key"))
        wanted = wanted.withColumn("_b", self.bucket(F.col("_key")))
        runs = self._runs(self.version() if version is None else version)
        held = F.when(F.col("_key").isNull(), F.col("nulls")).otherwise(F.col("_key").between(F.col("low"), F.col("high")))
        lines = runs.join(F.broadcast(wanted), (F.col("bucket") == F.col("_b")) & held).select("run", "number", "bucket").distinct().collect()
        here = {(r.run, r.number) for r in lines}
        same = F.lit(False)
        for v in values:
            same = same | F.col(self.key).eqNullSafe(F.lit(v).cast(self.kind)) if v is None else same | (F.col(self.key) == F.lit(v).cast(self.kind))
        return self._read(sorted(here), same, sorted({r.bucket for r in lines}))

    def lookup_many(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of all keys of a table (one column of the key's name): a join, after which a key's last row counts."""
        wanted = keys.select(F.col(self.key).alias("_key")).distinct()
        rows = self._read(self._named(version))
        return self._newest(rows.join(wanted, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi"))

    def by_index(self, column: str, value, version: int | None = None) -> DataFrame:
        """Rows that have a value in an indexed column: the index says which keys to look at, the rows whether they still have it."""
        keys = self.indexes[column].lookup(value).select(F.col("key").alias(self.key))
        return self.lookup_many(keys, version).where(F.col(column).eqNullSafe(F.lit(value)))

    def delete_by_index(self, column: str, values: DataFrame) -> int:
        """Removes all rows whose indexed column has one of the values (a table with that column): what deleting documents does to their pages."""
        wanted = values.select(F.col(column).alias("value")).distinct()
        hints = self.indexes[column].lookup_many(wanted).select(F.col("key").alias(self.key))
        sure = self.lookup_many(hints).join(wanted, F.col(column).eqNullSafe(F.col("value")), "left_semi")
        return self.write(gone=sure.select(self.key))

    # Compaction

    def compact(self, fan: int = 4, everything: bool = False) -> int:
        """Merges the runs of each level that has `fan` of them, newer and older ones together, into one of the next (or all runs into one). Marks of what is gone go with the oldest run."""
        now = self._runs(self.version())
        runs = now.groupBy("run", "level", "number").agg(F.sum("rows").alias("rows")).orderBy("number").collect()
        for level in sorted({r.level for r in runs}):
            # The runs of a level lie next to each other in age: those of lower levels are all newer.
            chosen = runs if everything else [r for r in runs if r.level == level]
            if len(chosen) >= (2 if everything else fan):
                self._merge([(r.run, r.number) for r in chosen], level + 1, oldest=chosen[0].number == runs[0].number)
                return self.version() if everything else self.compact(fan)
        for index in self.indexes.values():
            index.compact(fan, everything)
        return self.version()

    def _merge(self, chosen: list, level: int, oldest: bool) -> None:
        rows = self._newest(self._read(chosen), keep_marks=True)
        run, lines = self._write(rows.where(~F.col(GONE)) if oldest else rows, level)
        number = max(n for _, n in chosen)
        lines = shared.written(lines.withColumn("number", F.lit(number).cast("long")), "lines")
        names = [r for r, _ in chosen]

        def replace(runs: DataFrame) -> DataFrame | None:
            there = runs.where(F.col("run").isin(names)).select("run").distinct().count()
            # Another compaction took some of them: what this one made is nobody's, and goes with vacuum.
            return runs.where(~F.col("run").isin(names)).unionByName(lines) if there == len(names) else None

        self._commit(replace)

    def vacuum(self, since: int) -> list[str]:
        """Removes versions before `since` and the runs that none from it on names; no reader may hold an older version, and no writer be at work."""
        for v in (n for n in shared.children(self.spark, f"{self.root}/versions") if n.isdigit() and int(n) < since):
            shared.remove(self.spark, f"{self.root}/versions/{v}")
        named = {r for v in range(since, self.version() + 1) for r, _ in self._named(v)}
        loose = [n for n in shared.children(self.spark, self.root) if n.startswith("run-") and n not in named]
        for n in loose:
            shared.remove(self.spark, f"{self.root}/{n}")
        return loose
