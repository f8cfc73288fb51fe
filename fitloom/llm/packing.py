"""Best-fit packing by fitted patterns.

All decisions are made on the histogram of piece lengths, which has at most one row per length up
to the limit: patterns of two or three lengths that fill a sequence exactly, repeat counts fitted to
the histogram by non-negative least squares, and best-fit patterns for what rounding leaves. Pieces
are then numbered within their length and look their place up in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import Shipped, pieces, stored
from fitloom.llm.subwords import Encoder, broadcast_vocabulary

END_ID = 2
LIMIT = 1024


def document_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``limit`` ids: doc_id, piece, start, length, ids_crc32; ``part`` and ``nth`` number
    the pieces of one length within a task. A null text counts as empty: it has the end id only."""
    vocab = broadcast_vocabulary(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        part = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            for some in pieces(batch, "text"):
                ids, offsets = encoder.encode(some.column(1))
                raw = memoryview(ids.astype("<u4")).cast("B")
                totals = np.diff(offsets) + 1
                n = -(-totals // limit)
                first = totals - (n - 1) * limit
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(piece > 0, first[row] + (piece - 1) * limit, 0)
                length = np.where(piece > 0, limit, first[row])
                low = (offsets[row] + start) * 4
                last = piece == n[row] - 1
                high = low + (length - last) * 4
                sums = [crc32(raw[a:b]) for a, b in zip(low.tolist(), high.tolist())]
                for k in np.flatnonzero(last).tolist():
                    sums[k] = crc32(end, sums[k])
                # running number of each piece among those of its length
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                begin = np.searchsorted(ordered, ordered)
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - begin + seen[ordered]
                seen += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(sums, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def fit_patterns(histogram: np.ndarray, limit: int, rounds: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up ``histogram[length]`` exactly.

    Fitted patterns and best-fit ones for the rest; if fitting only the patterns of pieces over half the
    limit gives fewer sequences, that. The number of patterns depends on ``limit``
    only, not on the counts.
    """
    whole = histogram[:limit + 1].astype(np.int64)
    plans = []
    columns = _columns(whole, limit)
    for least in (1, limit // 2):
        left, out = whole.copy(), []
        some = columns[columns[:, 0] >= least]
        for row, times in zip(some.tolist(), _least_squares(some, left, rounds).tolist()):
            need: dict[int, int] = {}
            for x in row:
                if x:
                    need[x] = need.get(x, 0) + 1
            times = min([times, *(left[x] // k for x, k in need.items())])
            if times > 0:
                for x, k in need.items():
                    left[x] -= times * k
                out.append((tuple(x for x in row if x), int(times)))
        plans.append(out + _best_fit(left, limit))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _columns(histogram: np.ndarray, limit: int) -> np.ndarray:
    """Two or three lengths that occur and fill a sequence, longest first; 0 for "no third"."""
    have = np.flatnonzero(histogram[1:limit]) + 1
    present = np.zeros(limit + 1, bool)
    present[have] = True
    a, b = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
    c = limit - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    ok[ok] = (c[ok] == 0) | present[c[ok]]
    columns = np.stack([a[ok], b[ok], c[ok]], 1)
    # long pieces choose their partners first
    return columns[np.argsort(-columns[:, 0], kind="stable")]


def _best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """The longest piece that is left, then always the longest that still fits, as often as it goes."""
    out: list[tuple[tuple[int, ...], int]] = []
    while (rest := np.flatnonzero(left)).size:
        gap, pattern, used = limit, [], {}
        while True:
            fits = (x for x in rest[:np.searchsorted(rest, gap, side="right")][::-1].tolist() if left[x] > used.get(x, 0))
            if (x := next(fits, 0)) == 0:
                break
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        times = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= times * k
        out.append((tuple(pattern), times))
    return out


def _least_squares(columns: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative repeat counts whose patterns come nearest to the histogram, rounded.

    Multiplicative updates x * A'h / A'Ax keep every count non-negative.
    """
    target = target.astype(np.float64)
    target[0] = 0
    if not len(columns):
        return np.zeros(0, np.int64)
    pull = target[columns].sum(1)
    x = pull / (columns > 0).sum(1)
    x *= target.sum() / max(1.0, (x * (columns > 0).sum(1)).sum())
    for _ in range(rounds):
        made = np.zeros_like(target)
        for k in range(columns.shape[1]):
            made += np.bincount(columns[:, k], x, minlength=len(target))
        made[0] = 0
        x *= pull / np.maximum(made[columns].sum(1), 1e-12)
    return np.rint(x).astype(np.int64)


class Plan:
    """Where the k-th piece of a length goes; as large as the patterns are many."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], limit: int):
        slots: list[tuple[int, int, int, int]] = []  # length, first number, first sequence, offset
        used = np.zeros(limit + 1, np.int64)
        sequence = 0
        for lengths, times in patterns:
            offset = 0
            for x in lengths:
                slots.append((x, int(used[x]), sequence, offset))
                used[x] += times
                offset += x
            sequence += times
        self.sequences = sequence
        table = np.array(slots, np.int64).reshape(-1, 4)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.span = int(used.max(initial=0)) + 1
        self.keys = table[:, 0] * self.span + table[:, 1]
        self.first, self.sequence, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * self.span + number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """All documents in sequences of at most ``limit`` ids: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Repeated rows are packed as often as they stand there; an empty table gives none."""
    spark = docs.sparkSession
    cut = stored(document_pieces(docs, tokenizer, limit, end_id))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # number of pieces of a length in earlier tasks: one row per length and task
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(limit + 1, np.int64)
    # at most `limit` rows
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    plan = Shipped(spark, Plan(fit_patterns(histogram, limit), limit))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), number)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.join(bases, ["length", "part"]).select(*names, "nth", "base").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
