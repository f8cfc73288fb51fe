"""Catalogue and evaluation history."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.sources import store

JSON_COLUMNS = {"matched_skills": "array<string>", "missing_skills": "array<string>",
                "candidate_profile": "variant"}


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``new`` replace or join the rows of ``old``."""
    values = [c for c in old.columns if c != key]
    fresh = new.select(key, F.struct(*values).alias("_new"))
    kept = old.select(key, F.struct(*values).alias("_old"))
    merged = kept.join(fresh, key, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    return merged.select(key, *[F.col(f"_row.{c}").alias(c) for c in values])


def evaluation_id(*parts: str) -> Column:
    """Id from the row's own identity: a retried write gives the same id again."""
    digest = F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def evaluation_rows(scored: DataFrame, created_at: Column) -> DataFrame:
    """Analysis results as history rows, lists and profile as JSON text."""
    have = set(scored.columns)

    def opt(name, type_="string"):
        return (F.col(name) if name in have else F.lit(None)).cast(type_).alias(name)

    rows = scored.withColumn("created_at", created_at)
    profile = F.to_json(F.struct(*[c for c in ("skills", "experience", "projects", "education")
                                   if c in have])) if "skills" in have else F.lit(None)
    return rows.select(
        evaluation_id("doc_id", "target_key", "created_at").alias("id"), "created_at",
        opt("user_id", "long"), opt("cv_filename"), F.col("target_key").alias("occupation_key"),
        opt("occupation_display"), "match_score", "semantic_similarity_score",
        "weighted_skill_score", F.to_json("matched_skills").alias("matched_skills"),
        F.to_json("missing_skills").alias("missing_skills"),
        profile.cast("string").alias("candidate_profile"), opt("ai_recommendation"))


def append_evaluations(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


# --- a history for lookups ---------------------------------------------------------------------
# Rows lie in folders of their month, in files of disjoint id ranges sorted by id, with bloom filters on id. A
# manifest names the folders of every month, so readers see whole appends and whole compactions.

PERIOD = "period"
FILE_ROWS = 1_000_000


def _written(rows: DataFrame, path: str, file_rows: int) -> dict[str, str]:
    """New files of ``rows``: month -> folder."""
    month = F.coalesce(F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM"), F.lit("unknown"))
    rows, folder = rows.withColumn(PERIOD, month), f"data/{uuid.uuid4().hex}"
    files = max(1, -(-rows.count() // file_rows))
    (rows.repartitionByRange(files, PERIOD, "id").sortWithinPartitions(PERIOD, "id")
     .write.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(file_rows))
     .partitionBy(PERIOD).parquet(f"{path}/{folder}"))
    names = [n for n in store._names(rows.sparkSession, f"{path}/{folder}") if n.startswith(f"{PERIOD}=")]
    return {n.removeprefix(f"{PERIOD}="): f"{folder}/{n}" for n in names}


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    known = store.versions(spark, path)
    return (known[-1], store._manifest(spark, path, known[-1])) if known else (0, {"buckets": {}, "taken": []})


def _committed(spark: SparkSession, path: str, change) -> None:
    """Commit ``change(manifest)`` on top of the newest version; other writers only make it try again."""
    while True:
        number, manifest = _manifest(spark, path)
        try:
            store._commit(spark, path, number + 1, {**change(manifest), "at": time.time()})
            return
        except store.Conflict:
            continue


def _added(folders: dict[str, str], schema: str, taken: list[str]):
    def change(manifest: dict) -> dict:
        buckets = {m: list(f) for m, f in manifest["buckets"].items()}
        for month, folder in folders.items():
            buckets.setdefault(month, []).append(folder)
        return {"buckets": buckets, "schema": manifest.get("schema", schema), "taken": sorted({*manifest["taken"], *taken})}
    return change


def record(rows: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Append evaluations (id, created_at, ...) to the history in ``path``; readers see all of them or none."""
    path = path.rstrip("/")
    _committed(rows.sparkSession, path, _added(_written(rows, path, file_rows), rows.schema.json(), []))


def absorb_stream(spark: SparkSession, stream_path: str, path: str, file_rows: int = FILE_ROWS) -> list[str]:
    """Take the batches that a stream has finished in ``stream_path`` (batch_id=...) into the history, each one once;
    returns their folders, which can then be removed."""
    path, stream_path = path.rstrip("/"), stream_path.rstrip("/")
    taken = set(_manifest(spark, path)[1]["taken"])
    fs, _ = store._filesystem(spark, stream_path)
    done = [n for n in store._names(spark, stream_path) if n.startswith("batch_id=") and n not in taken
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{stream_path}/{n}/_SUCCESS"))]
    if done:
        rows = spark.read.parquet(*(f"{stream_path}/{n}" for n in done))
        _committed(spark, path, _added(_written(rows, path, file_rows), rows.schema.json(), done))
    return [f"{stream_path}/{n}" for n in done]


def compact(spark: SparkSession, path: str, grace_seconds: float = store.GRACE_SECONDS, file_rows: int = FILE_ROWS) -> list[str]:
    """Write the months that lie in several folders anew, as one with disjoint id ranges; returns the months.

    Open frames keep reading the old files for ``grace_seconds``; what is appended meanwhile stays beside.
    """
    path = path.rstrip("/")
    old = _manifest(spark, path)[1]["buckets"]
    many = {m: f for m, f in old.items() if len(f) > 1}
    if many:
        rows = read_history(spark, path, sorted(many)).drop(PERIOD)
        fresh = _written(rows, path, file_rows)

        def change(manifest: dict) -> dict:
            later = {m: [f for f in folders if f not in many.get(m, [])] for m, folders in manifest["buckets"].items()}
            return {**manifest, "buckets": {m: ([fresh[m]] if m in fresh else []) + f for m, f in later.items()}}
        _committed(spark, path, change)
    store.expire(spark, path, grace_seconds)
    return sorted(many)


def months(spark: SparkSession, path: str) -> list[str]:
    """Months that the history has, oldest first; rows without a time are in the month "unknown", the last one."""
    return sorted(_manifest(spark, path.rstrip("/"))[1]["buckets"])


def read_history(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """All rows of the history with their ``period``, or those of some months."""
    path = path.rstrip("/")
    manifest = _manifest(spark, path)[1]
    if "schema" not in manifest:
        raise FileNotFoundError(f"no history is stored in {path}")
    schema = store.T.StructType.fromJson(store.json.loads(manifest["schema"])).add(PERIOD, "string")
    folders = [(m, f) for m, own in manifest["buckets"].items() for f in own if only is None or m in only]
    parts = {}
    for m, f in folders:
        parts.setdefault(f.rsplit("/", 1)[0], []).append(f)
    frames = [spark.read.schema(schema).option("basePath", f"{path}/{base}").parquet(*(f"{path}/{f}" for f in own)) for base, own in parts.items()]
    out = spark.createDataFrame([], schema)
    for k, frame in enumerate(frames):
        out = frame if k == 0 else out.unionByName(frame)
    return out


def newest(spark: SparkSession, path: str, limit: int = 50, key: str | None = None) -> DataFrame:
    """A10: the newest evaluations of the history, of one group when ``key`` is given.

    Months are read from the last one backwards, and no further than the limit needs.
    """
    known = months(spark, path)
    timed = [m for m in known if m != "unknown"]
    wanted, found = [], 0
    for month in [*reversed(timed), *(m for m in known if m == "unknown")]:
        wanted.append(month)
        rows = read_history(spark, path, [month])
        found += (rows if key is None else rows.filter(F.col("occupation_key") == key)).limit(limit).count()
        if found >= limit:
            break
    return list_evaluations(read_history(spark, path, wanted).drop(PERIOD), limit, key)


def parse_json_columns(rows: DataFrame) -> DataFrame:
    """JSON text columns as values; text that does not parse shows up in ``<column>_text``.

    A list column that is null or unusable reads as an empty list.
    """
    have = [c for c in JSON_COLUMNS if c in rows.columns]
    out = {}
    for c in have:
        if JSON_COLUMNS[c] == "variant":
            parsed = F.try_parse_json(c)
            out[c] = parsed
        else:
            parsed = F.try_variant_get(F.try_parse_json(c), "$", JSON_COLUMNS[c])
            out[c] = F.coalesce(parsed, F.array().cast("array<string>"))
        out[f"{c}_text"] = F.when(parsed.isNull(), F.col(c))
    return rows.withColumns(out)


def list_evaluations(history: DataFrame, limit: int = 50, key: str | None = None) -> DataFrame:
    """A10: newest evaluations, of one group when ``key`` is given."""
    rows = history.filter(F.col("occupation_key") == key) if key else history
    return parse_json_columns(rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit))


def get_evaluation(history: DataFrame, eval_id) -> DataFrame:
    """The evaluation with this id: one row or none (the filter reaches the scan)."""
    return parse_json_columns(history.filter(F.col("id") == eval_id))


def get_group(profiles: DataFrame, key: str) -> DataFrame:
    return profiles.filter(F.col("key") == key)
