"""The keyed log against a dictionary: edits, lookups, what they read, compaction beside readers and writers."""

import random
import re
import threading

import pytest

from pliego.sources import keylog, shared

SCHEMA = "id long, doc_id long, texto string"


def log(spark, root, **more):
    return keylog.KeyLog(spark, f"file://{root}", SCHEMA, buckets=4, indexed=("doc_id",), **more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_log_is_a_dictionary(spark, tmp_path):
    store, held, rng = log(spark, tmp_path), {}, random.Random(5)
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    kept = {}
    for step in range(7):
        new = {i: (i, rng.choice([1, 2, 3, None]), f"{step}.{i}") for i in rng.sample([None, *range(30)], 9)}
        gone = rng.sample(range(30), 3)
        held = {k: v for k, v in held.items() if k not in gone} | new
        version = store.write(frame(list(new.values())), spark.createDataFrame([(k,) for k in gone], "id long"))
        kept[version] = dict(held)
        if step in (3, 5):
            version = store.compact(2)
            kept[version] = dict(held)
    for version, was in kept.items():
        assert rows(store.scan(version)) == sorted(was.values(), key=repr)
    store.compact(everything=True)
    assert rows(store.scan()) == sorted(held.values(), key=repr)
    for k in [None, 0, 7, 13, 29, 99]:
        assert rows(store.lookup(k)) == ([held[k]] if k in held else [])
    for d in (1, 2, None, 9):
        assert rows(store.by_index("doc_id", d)) == sorted((r for r in held.values() if r[1] == d), key=repr)
    many = spark.createDataFrame([(3,), (None,), (4,), (4,), (77,)], "id long")
    assert rows(store.lookup_many(many)) == sorted((held[k] for k in (3, None, 4) if k in held), key=repr)
    store.delete_by_index("doc_id", spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert rows(store.scan()) == sorted((r for r in held.values() if r[1] not in (1, None)), key=repr)
    store.compact(everything=True)
    assert rows(store.scan()) == sorted((r for r in held.values() if r[1] not in (1, None)), key=repr)
    assert store.vacuum(store.version()) and rows(store.scan()) == sorted((r for r in held.values() if r[1] not in (1, None)), key=repr)


def explained(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_lookup_reads_one_bucket_of_the_runs_that_may_have_the_key(spark, tmp_path):
    store = log(spark, tmp_path)
    for a in (0, 1000, 2000):
        store.write(spark.createDataFrame([(a + k, k % 7, "x") for k in range(200)], SCHEMA))
    found = store.lookup(1042)
    files = found.inputFiles()
    plan = explained(spark, found)
    assert rows(found) == [(1042, 0, "x")]
    assert len({re.search("run-[0-9a-f]+", f)[0] for f in files}) == 1  # of three runs, that whose range holds the key
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and "EqualTo(id,1042)" in plan
    assert store.lookup(5000).inputFiles() == [] and store.lookup(500).isEmpty()


def test_empty_batches_and_an_empty_log(spark, tmp_path):
    store = log(spark, tmp_path)
    assert store.scan().count() == 0 and store.lookup(1).count() == 0 and store.by_index("doc_id", 1).count() == 0 and store.compact() == 0
    store.write(spark.createDataFrame([], SCHEMA))
    store.write(gone=spark.createDataFrame([(1,)], "id long"))
    assert store.scan().count() == 0 and store.scan().columns == ["id", "doc_id", "texto"]


def test_readers_and_writers_beside_compaction(spark, tmp_path):
    store = log(spark, tmp_path)
    for k in range(4):
        store.write(spark.createDataFrame([(i, k, f"{k}") for i in range(20)], SCHEMA))
    reader, errors = store.scan(), []
    want = [(i, 3, "3") for i in range(20)]

    def write(n):
        try:
            log(spark, tmp_path).write(spark.createDataFrame([(100 + n, 9, "w")], SCHEMA))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)] + [threading.Thread(target=lambda: log(spark, tmp_path).compact(everything=True))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert rows(reader) == sorted(want, key=repr)  # of the version that it opened
    assert rows(store.scan()) == sorted(want + [(100 + n, 9, "w") for n in range(3)], key=repr)


def test_a_version_number_is_taken_once(spark, tmp_path):
    spark.range(1).write.parquet(f"file://{tmp_path}/a")
    spark.range(2).write.parquet(f"file://{tmp_path}/b")
    assert shared.rename(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/v")
    assert not shared.rename(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/v")


@pytest.mark.parametrize("everything", [False, True])
def test_marks_of_what_is_gone_outlive_merges_of_newer_runs(spark, tmp_path, everything):
    store = log(spark, tmp_path)
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    for k in range(4):
        store.write(frame([(k, 1, "old")]))
    store.compact(4)  # one run of level 1
    store.write(gone=spark.createDataFrame([(2,)], "id long"))
    for k in range(3):
        store.write(frame([(50 + k, 1, "new")]))
    store.compact(4, everything)
    assert [r[0] for r in rows(store.scan())] == [0, 1, 3, 50, 51, 52]
