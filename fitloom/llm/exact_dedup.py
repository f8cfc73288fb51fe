"""Exact deduplication by content-defined chunk recipes.

A text with its white space normalised is cut where a rolling hash of the last 32 bytes has a given
value, so equal stretches give equal chunks wherever they stand. Chunks are deduplicated to
identifiers of 64 bits, verified by SHA-256: where two different chunks share a 64-bit name, they are
told apart by a number. A document is then its ordered list of identifiers; the text itself never
leaves the task that read it, and lists are compared as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import pieces, rank_last, row_id, stored, text_buffer

WINDOW = 32
# A chunk has 1024 bytes on average, and 2^14 at most.
CHUNK_BITS = 10
CHUNK_MOST = 1 << 14
BLANKS = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, also at both ends."""
    words = b" ".join(text.split())
    if not words:
        return text and b" "
    return b" " * (text[0] in BLANKS) + words + b" " * (text[-1] in BLANKS)


def rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at every place: sum of table[byte] * 2^age, modulo 2^32."""
    codes = np.arange(256, dtype=np.uint64) + np.uint64(1)
    table = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)
    out = table[raw]
    step = 1
    while step < WINDOW:
        older = out[:-step] << np.uint32(step)
        out[step:] += older
        step *= 2
    return out


def cut_points(raw: np.ndarray, hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one text: after each place, from the 32nd on, whose hash starts with
    zeros, and wherever a chunk would become too long."""
    ends = np.flatnonzero(hashes[WINDOW - 1:] >> np.uint32(32 - CHUNK_BITS) == 0) + WINDOW
    out, last = [], 0
    for end in [*ends.tolist(), len(raw)]:
        while end - last > CHUNK_MOST:
            last += CHUNK_MOST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def recipes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, text_sha256, and name (64-bit) and proof (SHA-256) of every chunk in order."""

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = text_buffer(piece.column(2))
                whole: list[str] = []
                names: list[list[int]] = []
                proofs: list[list[bytes]] = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = normalise(raw[a:b].tobytes())
                    whole.append(hashlib.sha256(text).hexdigest())
                    view = np.frombuffer(text, np.uint8)
                    chunks = []
                    last = 0
                    for end in cut_points(view, rolling(view)):
                        chunks.append(text[last:end])
                        last = end
                    names.append([xxhash.xxh64_intdigest(c) - (1 << 63) for c in chunks])
                    proofs.append([hashlib.sha256(c).digest() for c in chunks])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(whole, pa.string()), pa.array(names, pa.list_(pa.int64())),
                     pa.array(proofs, pa.list_(pa.binary()))], ["row", "doc_id", "text_sha256", "names", "proofs"])

    frame = docs.select((row_id() if row is None else row).alias("row"), "doc_id", "text")
    kinds = [frame.schema[c].dataType.simpleString() for c in ("row", "doc_id")]
    return frame.mapInArrow(
        cook, f"row {kinds[0]}, doc_id {kinds[1]}, text_sha256 string, names array<long>, proofs array<binary>")


def identified(table: DataFrame) -> DataFrame:
    """Replace the proofs of `recipes` by ``variants``: for each chunk whose name belongs to several
    contents, its place and the number of its content; empty nearly always."""
    chunks = table.select("row", F.posexplode(F.arrays_zip("names", "proofs")).alias("at", "c"))
    chunks = chunks.select("row", "at", F.col("c.names").alias("name"), F.col("c.proofs").alias("proof"))
    contents = chunks.groupBy("name", "proof").agg(F.count("*").alias("uses"))
    # contents of one name: one, unless 64 bits collide
    number = F.row_number().over(Window.partitionBy("name").orderBy("proof"))
    clashes = contents.withColumn("variant", number).filter("variant > 1").select("name", "proof", "variant")
    marks = chunks.join(clashes, ["name", "proof"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "variant"))).cast("string").alias("variants"))
    return table.drop("proofs").join(marks, "row", "left").fillna("", ["variants"])


def exact_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space; a
    null text counts as empty. Of equal texts the row with the smallest doc_id stays (null ids count as
    the largest, repeated ids are told apart by row), so exactly one row of a group is kept. An empty
    table gives no rows.
    """
    lists = identified(stored(recipes(docs, row)))
    first = F.struct(rank_last(F.col("doc_id")).alias("rank"), "row")
    groups = lists.groupBy("names", "variants").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return lists.join(groups, ["names", "variants"]).select(
        "row", "doc_id", F.col("first.rank.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
