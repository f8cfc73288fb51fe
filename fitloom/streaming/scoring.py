"""Scoring of arriving documents."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitloom.plans.analysis import analyze, rejected
from fitloom.plans.materialize import cut, no_shuffles_left, scope
from fitloom.sources import store
from fitloom.sources.history import evaluation_rows

log = logging.getLogger(__name__)


def once(docs: DataFrame, within: str, event_time: str | None = None) -> DataFrame:
    """Documents of a stream without those delivered again ``within`` that time.

    Documents are the same by doc_id and target_key, those without an id by their whole content. Time
    is the column ``event_time``, else when a document arrives; the state that is kept ends with it.
    """
    whole = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    marked = docs.withColumns({
        "_time": F.current_timestamp() if event_time is None else F.col(event_time),
        "_same": F.when(F.col("doc_id").isNull(), whole).otherwise(F.lit(""))})
    return (marked.withWatermark("_time", within).dropDuplicatesWithinWatermark(["doc_id", "target_key", "_same"])
            .drop("_time", "_same"))


def score_stream(docs: DataFrame, kb: DataFrame | str, scores_path: str, checkpoint: str,
                 history_path: str | None = None, rejected_path: str | None = None,
                 available_now: bool = True, once_within: str | None = None, event_time: str | None = None, **options) -> StreamingQuery:
    """Score a stream of documents against profiles.

    ``kb`` is a table, or the path of a profile store. From a store each batch takes the version that is
    current when it starts and keeps to it, so a store that is rewritten meanwhile does no harm and the
    next batch sees the new profiles. With ``once_within`` a document delivered again within that time
    is left out (`once`).

    Every batch is analysed as a table. It owns the folder of its id and replaces it, so a
    repeated batch cannot write twice; what it stores on the way is removed when it ends. Documents
    without an id, a usable vector or a known group go to ``rejected_path`` with the reason. The
    history is written after the scores and a failure there is logged, not raised: it must not lose a score.
    """
    def profiles(spark: SparkSession) -> DataFrame:
        if isinstance(kb, str):
            return store.read_profiles(spark, kb, store.versions(spark, kb)[-1])
        return kb

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with no_shuffles_left(spark):
            with scope(spark):
                arrived, groups = cut(batch), profiles(spark)
                analyze(arrived, groups, is_stored=True, **options).write.mode("overwrite").parquet(f"{scores_path}/batch_id={batch_id}")
                if rejected_path is not None:
                    rejected(arrived, groups).write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
            if history_path is None:
                return
            # the batch's own copies are gone by now
            try:
                stored = spark.read.parquet(f"{scores_path}/batch_id={batch_id}")
                evaluation_rows(stored, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")) \
                    .write.mode("overwrite").parquet(f"{history_path}/batch_id={batch_id}")
            except Exception:  # noqa: BLE001
                log.exception("history of batch %s was not written", batch_id)

    arriving = docs if once_within is None else once(docs, once_within, event_time)
    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
