import glob
import threading

import pytest
from pyspark.sql import functions as F

from fitloom.plans import materialize
from fitloom.plans.analysis import analyze
from fitloom.sources import store
from fitloom.streaming import scoring

KB = "key string, core_skills array<struct<item:string,weight:double>>, optional_skills array<struct<item:string,weight:double>>, embedding array<float>"
DOCS = "doc_id long, target_key string, skills array<string>, embedding array<float>"


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return set(glob.glob(f"{path}/data/*/*/*.parquet"))


def numbers(spark, pairs):
    return spark.createDataFrame(pairs, "key string, n int")


def test_a_frame_reads_its_version_after_rewrites(spark, tmp_path):
    path = f"{tmp_path}/kb"
    assert store.write_profiles(numbers(spark, [("a", 1), ("b", 2)]), path) == 1
    first = store.read_profiles(spark, path)
    assert store.write_profiles(numbers(spark, [("a", 5)]), path) == 2
    assert store.merge_profiles(numbers(spark, [("a", 6), ("c", 7)]), path) == 3
    assert values(first) == [("a", 1), ("b", 2)] == values(store.read_profiles(spark, path, 1))
    assert values(store.read_profiles(spark, path)) == [("a", 6), ("c", 7)]
    store.expire(spark, path, 0)
    assert store.versions(spark, path) == [3] and values(store.read_profiles(spark, path)) == [("a", 6), ("c", 7)]
    with pytest.raises(FileNotFoundError):
        store.read_profiles(spark, path, 1)


def test_a_merge_keeps_the_files_of_unchanged_groups(spark, tmp_path):
    path = f"{tmp_path}/kb"
    store.write_profiles(numbers(spark, [(f"k{i}", i) for i in range(200)]), path)
    before = files(path)
    assert store.merge_profiles(numbers(spark, [("k3", 3), ("k4", 4)]), path) == 1 and files(path) == before
    assert store.merge_profiles(numbers(spark, [("k3", 30), ("k4", 4), ("new", 1)]), path) == 2
    store.expire(spark, path, 0)
    kept = files(path) & before
    assert 14 * len(before) / 16 <= len(kept) < len(before)
    assert values(store.read_profiles(spark, path)) == sorted([(f"k{i}", 30 if i == 3 else i) for i in range(200)] + [("new", 1)], key=repr)
    store.merge_profiles(spark.createDataFrame([("k5", "x")], "key string, more string"), path)
    assert ("k5", None, "x") in values(store.read_profiles(spark, path)) and ("k6", 6, None) in values(store.read_profiles(spark, path))


def test_only_one_writer_makes_a_version(spark, tmp_path):
    path = f"{tmp_path}/kb"
    store.write_profiles(numbers(spark, [("a", 1)]), path)
    store._commit(spark, path, 2, store._manifest(spark, path, 1))
    with pytest.raises(store.Conflict):
        store._commit(spark, path, 2, {})
    assert values(store.read_profiles(spark, path)) == [("a", 1)]


def test_an_empty_store(spark, tmp_path):
    path = f"{tmp_path}/kb"
    store.write_profiles(numbers(spark, []), path)
    assert store.read_profiles(spark, path).count() == 0
    store.merge_profiles(numbers(spark, [(None, 1), ("a", 2)]), path)
    assert values(store.read_profiles(spark, path)) == [("a", 2), (None, 1)]


def test_scopes_remove_what_their_thread_stored(spark):
    outside = materialize.cut(spark.range(3))
    with materialize.scope(spark):
        inside = materialize.cut(spark.range(4))
        found = []
        other = threading.Thread(target=lambda: found.append(materialize.cut(spark.range(5))))
        other.start()
        other.join()
        assert inside.count() == 4
    folder = inside.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert not glob.glob(f"{folder}/*.parquet")
    assert outside.count() == 3 and found[0].count() == 5


def test_a_stream_follows_its_store_and_leaves_nothing_behind(spark, tmp_path):
    def kb(weight):
        return spark.createDataFrame([("web", [("SQL", weight), ("Go", 0.5)], [], [1.0, 0.0])], KB)

    docs = [(1, "web", ["sql"], [1.0, 0.0]), (2, "web", ["go"], [1.0, 0.0]), (3, "ops", ["go"], [1.0, 0.0]), (None, "web", ["go"], [1.0, 0.0])]
    store.write_profiles(kb(0.5), f"{tmp_path}/kb")
    shared = materialize.shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{shared}/fitloom-*"))

    def deliver(n, rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        arriving = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n=*")
        scoring.score_stream(arriving, f"{tmp_path}/kb", f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/history", f"{tmp_path}/rejected",
                             once_within="1 day").awaitTermination()

    deliver(1, docs)
    store.write_profiles(kb(1.5), f"{tmp_path}/kb", grace_seconds=0)  # the old files are gone at once
    deliver(2, docs + [(4, "web", ["sql"], [1.0, 0.0])])
    deliver(3, [(1, "ops", ["go"], [1.0, 0.0])] + docs)
    scores = {r.doc_id: r.weighted_skill_score for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3 and scores == {1: 0.5, 2: 0.5, 4: 0.75}
    assert sorted((r.doc_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejected").filter("doc_id is not null").collect()) == [(1, "group"), (3, "group")]
    assert spark.read.parquet(f"{tmp_path}/rejected").filter("reason = 'id'").count() == 1
    assert set(glob.glob(f"{shared}/fitloom-*")) == before


def test_analysis_reads_its_inputs_once(spark):
    kb = spark.createDataFrame([("web", [("SQL", 1.0)], [], [1.0])], KB)
    docs = spark.createDataFrame([(1, "web", ["sql"], [1.0])], DOCS).withColumn("doc_id", F.col("doc_id") + (F.rand() * 0).cast("long"))
    plan = analyze(docs, kb)._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in plan and "LogicalRDD" not in plan
