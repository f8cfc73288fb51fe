"""Token counts: an exact histogram of encoded lengths answers every question about context limits.

Documents are aggregated by length, so the corpus shrinks to one row per distinct length. Sums over
all longer lengths then give, at each limit, how many documents exceed it and how many tokens are
left after truncation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import pieces, stored
from fitloom.llm.subwords import Encoder, broadcast_vocabulary

# Lengths of one block are summed in one task, then the blocks; both stay below 2^16 rows, since a
# text has less than 2^31 bytes and so fewer tokens.
BLOCK = 1 << 15


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``n_tokens`` of every row; a null text counts as empty."""
    vocab = broadcast_vocabulary(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(encoder.lengths(piece.column(0)), pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, with sums over it and all longer ones.

    n_docs; docs_from, tokens_from: documents of at least this length, and their tokens; share_to:
    share of documents of at most this length, so the first row with share_to >= q is quantile q;
    truncated: tokens left when every document is cut to this length. Between two lengths a < L < b
    the answer for limit L is exact too: ``truncated(b) - (b - L) * docs_from(b)``. Repeated rows count
    as often as they stand there. An empty table gives no rows.
    """
    # read by two branches: without this every text would be encoded twice
    counts = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    # at most 2^31 / BLOCK rows
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")),
        F.sum("docs").over(Window.partitionBy()).alias("all_docs"), F.sum("tokens").over(Window.partitionBy()).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside) + F.col("later_tokens")).alias("tokens_from"))
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated"))
