"""Small helpers of the operators: row identity, Arrow pieces, folders for intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitloom.plans import materialize

PIECE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later branches don't repeat its work,
    and lost executors cost nothing."""
    return materialize.cut(df)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_id() -> Column:
    """Identity of a row of a stored table: repeated rows and repeated or missing ids stay apart.

    Two scans of one file-based DataFrame give a row the same number, since both read the same splits.
    """
    return F.monotonically_increasing_id()


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` (word, n) with the largest n, ``most`` at most.

    Cut at a power of 2^(1/16), which a histogram of a few hundred rows decides, so no task sends rows
    that are not wanted. Fewer than ``most`` where the next step would be too many.
    """
    step = F.floor(F.log2(F.col("n")) * 16)
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for row in sorted(found, key=lambda r: -r["step"]):
        total += row["rows"]
        if total > most:
            break
        least = row["step"]
    return counts.filter(F.lit(False) if least is None else step >= least)


def rank_last(doc_id: Column) -> Column:
    """Sort key that puts null ids after all others."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``limit`` bytes; no row is split or left out."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 row offsets into them; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def stable_row(df: DataFrame) -> Column:
    """Identity of a row that holds across scans, whatever splits they read: file and place in it.

    Frames that don't come from files get the running number of `row_id`.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return F.struct(F.lit(0).cast("long").alias("file"), row_id().alias("place"))
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def keep_only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose `stable_row` is among ``kept.row``, with the columns of ``docs``."""
    name = fresh(docs, "row")
    marked = docs.withColumn(name, stable_row(docs))
    return marked.join(kept.select(F.col("row").alias(name)), name, "left_semi").select(*docs.columns)


class Shipped:
    """A broadcast object whose class travels with it: executors need no copy of this package."""

    def __init__(self, spark: SparkSession, thing):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
        self.thing = thing

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "thing": None}

    @property
    def value(self):
        if self.thing is None:
            self.thing = cloudpickle.loads(self.sent.value)
        return self.thing
