import pytest
from pyspark.sql import functions as F

from fitloom.sources import history, store

N = 4000


def rows(spark, start, n, month=1):
    return spark.range(start, start + n).select(
        F.xxhash64("id").alias("id"), F.format_string(f"2024-{month:02d}-%02d 10:00:%02d", F.col("id") % 28 + 1, F.col("id") % 60).alias("created_at"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("occupation_key"), F.lit('["a"]').alias("matched_skills"), F.col("id").alias("n"))


def scanned(df):
    """Rows that the scans of an executed query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return total


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    path = f"{tmp_path}/h"
    spark.conf.set("parquet.block.size", "8192")
    try:
        for k in range(4):
            history.record(rows(spark, k * N, N), path)
        before = history.read_history(spark, path)
        assert history.compact(spark, path, grace_seconds=1000) == ["2024-01"] and history.compact(spark, path) == []
    finally:
        spark.conf.unset("parquet.block.size")
    whole = history.read_history(spark, path)
    assert whole.count() == 4 * N == before.count() == whole.select("id").distinct().count()
    wanted = rows(spark, 777, 1).first()
    got = history.get_evaluation(whole, wanted.id)
    assert [r.n for r in got.collect()] == [777]
    assert 1 <= scanned(whole.filter(F.col("id") == wanted.id)) < N  # of 16 000
    assert history.get_evaluation(whole, -5).count() == 0


def test_newest_first_reads_the_last_months_only(spark, tmp_path):
    path = f"{tmp_path}/h"
    for month in (1, 2, 3):
        history.record(rows(spark, month * N, 100, month), path)
    history.record(rows(spark, 9 * N, 1).withColumn("created_at", F.lit(None).cast("string")), path)
    assert history.months(spark, path) == ["2024-01", "2024-02", "2024-03", "unknown"]
    every = history.read_history(spark, path).drop("period")
    for limit, key in ((10, None), (50, "g1"), (150, None), (1000, None)):
        want = [r.n for r in history.list_evaluations(every, limit, key).collect()]
        assert [r.n for r in history.newest(spark, path, limit, key).collect()] == want and len(want) == min(limit, 301)
    plan = history.newest(spark, path, 10)._jdf.queryExecution().optimizedPlan().toString()
    files = history.newest(spark, path, 10).inputFiles()
    assert files and all("period=2024-03" in f for f in files), plan


def test_stream_batches_are_absorbed_once(spark, tmp_path):
    for k in range(3):
        rows(spark, k * 10, 10).write.parquet(f"{tmp_path}/stream/batch_id={k}")
    (tmp_path / "stream" / "batch_id=9").mkdir()  # not finished
    path = f"{tmp_path}/h"
    assert len(history.absorb_stream(spark, f"{tmp_path}/stream", path)) == 3
    rows(spark, 30, 10).write.parquet(f"{tmp_path}/stream/batch_id=3")
    assert [f[-10:] for f in history.absorb_stream(spark, f"{tmp_path}/stream", path)] == ["batch_id=3"]
    assert history.absorb_stream(spark, f"{tmp_path}/stream", path) == []
    history.compact(spark, path, grace_seconds=0)
    assert sorted(r.n for r in history.read_history(spark, path).collect()) == list(range(40))
    assert len(store.versions(spark, path)) == 1
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, f"{tmp_path}/none")
