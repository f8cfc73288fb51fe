"""SimHash near-duplicates by a join on segment bit counts.

Bit counts of the 32 two-bit segments of a fingerprint are a point whose Manhattan distance to
another one is at most the number of differing bits. Counts 0, 1, 2 written as 00, 01, 11 make that
distance a number of differing bits as well. The segments form seven blocks: of two points within
distance four, at least three blocks agree, so each triple of blocks is a grid on which such points
share a cell. Points of a cell are compared by that lower bound, then by the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import pieces, rank_last, row_id, stored, text_buffer
from fitloom.llm.components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
BLOCKS = 7
# Cells of more points are compared block by block in tasks of their own.
HEAVY = 4096
HALF = 2048
FEW = 16
LOW_BITS = 0x5555555555555555


def bit_table() -> np.ndarray:
    return (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: bytes, shingle: int, bits: np.ndarray) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 if it has no word."""
    text = b" ".join(text.lower().split())
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(text)]
    if len(ends) > shingle:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    else:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((raw + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    counts = (seen @ bits).ravel()
    set_ = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(k) for k in set_)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """row, doc_id, print (as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bit_table()
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = text_buffer(piece.column(2))
                prints = np.array([fingerprint(raw[a:b].tobytes(), shingle, bits)
                                   for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(prints.view(np.int64))], ["row", "doc_id", "print"])

    frame = docs.select((row_id() if row is None else row).alias("row"), "doc_id", "text")
    kinds = [frame.schema[c].dataType.simpleString() for c in ("row", "doc_id")]
    return frame.mapInArrow(run, f"row {kinds[0]}, doc_id {kinds[1]}, print long")


def embedded(fingerprint: Column) -> Column:
    """Counts of the two-bit segments, each as 00, 01 or 11."""
    low = F.lit(LOW_BITS)
    shifted = F.shiftrightunsigned(fingerprint, 1)
    return fingerprint.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(
        F.shiftleft(fingerprint.bitwiseAND(shifted).bitwiseAND(low), 1))


def _embedded(prints: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    return (prints | prints >> one) & low | (prints & prints >> one & low) << one


def grid_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """Segments of each choice of ``blocks - most`` blocks, as signed masks."""
    edges = [round(32 * k / blocks) * 2 for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(own, blocks - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _close(prints: np.ndarray, points: np.ndarray, some: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are near: by the lower bound, then exactly."""
    near = np.bitwise_count(points[some][:, None] ^ points[others]) <= most
    return near & (np.bitwise_count(prints[some][:, None] ^ prints[others]) <= most)


def _stars(prints: np.ndarray, most: int, side: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """Components of the prints, each as its first member and the rest: every print is compared with all
    that are not yet reached, and only as many links leave as there are prints. With ``side``, only
    links between the two sides count."""
    points = _embedded(prints)
    left, out = np.arange(len(prints)), []
    while len(left):
        root, left = left[0], left[1:]
        edge, reached = np.array([root]), []
        while len(edge) and len(left):
            some, edge = edge[:64], edge[64:]
            near = _close(prints, points, some, left, most)
            if side is not None:
                near &= side[some][:, None] != side[left]
            hit = near.any(0)
            found, left = left[hit], left[~hit]
            reached.append(found)
            edge = np.concatenate((edge, found))
        if reached and sum(map(len, reached)):
            out.append((int(root), np.concatenate(reached)))
    return out


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    join = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64))
    return join(a), join(b)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and group starts of whole groups from batches sorted by the first ``keys`` columns."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns)]
        if not len(columns[0]):
            continue
        new = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        if len(starts) > 1:
            yield [c[:starts[-1]] for c in columns], starts[:-1]
        kept = [c[starts[-1]:] for c in columns]
    if kept is not None and len(kept[0]):
        yield kept, np.zeros(1, np.int64)


def near_links(prints: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct prints that connect exactly those within ``most`` differing bits.

    All near pairs are found; from a cell with many of them only as many links are returned as keep
    its prints connected, so a group of copies gives links in proportion to its size.
    """
    point = embedded(F.col("print"))
    cells = prints.select("print", F.posexplode(F.array(*(
        point.bitwiseAND(F.lit(m)) for m in grid_masks(blocks, most)))).alias("grid", "cell"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grid, cell, own), starts in _groups(batches, 2):
            own = own.view(np.uint64)
            points = _embedded(own)
            sizes = np.diff(np.append(starts, len(own)))
            group = np.repeat(np.arange(len(starts)), sizes)
            few = np.flatnonzero(sizes[group] <= FEW)
            small, p, e = group[few], own[few], points[few]
            a, b = [], []
            for step in range(1, FEW):
                same = np.flatnonzero(small[step:] == small[:-step])
                if not len(same):
                    break
                same = same[np.bitwise_count(e[same] ^ e[same + step]) <= most]
                same = same[np.bitwise_count(p[same] ^ p[same + step]) <= most]
                a.append(p[same])
                b.append(p[same + step])
            big: list[int] = []
            for g in np.flatnonzero(sizes > FEW).tolist():
                if sizes[g] > HEAVY:
                    big.append(g)
                    continue
                members = own[starts[g]:starts[g] + sizes[g]]
                for root, rest in _stars(members, most):
                    a.append(np.full(len(rest), members[root]))
                    b.append(members[rest])
            left, right = _links(a, b)
            none = pa.nulls(len(left), pa.int32())
            yield pa.RecordBatch.from_arrays([left, right, none, none.cast(pa.int64()), none], ["a", "b", "grid", "cell", "block"])
            for g in big:
                part = slice(starts[g], starts[g] + sizes[g])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[part].view(np.int64)), pa.nulls(int(sizes[g]), pa.int64()), pa.array(grid[part].astype(np.int32)),
                     pa.array(cell[part]), pa.array((np.arange(sizes[g]) // HALF).astype(np.int32))], ["a", "b", "grid", "cell", "block"])

    dealt = cells.select("grid", "cell", "print").repartition("grid", "cell").sortWithinPartitions("grid", "cell", "print")
    found = stored(dealt.mapInArrow(scan, "a long, b long, grid int, cell long, block int"))
    heavy = found.filter("block is not null").select("grid", "cell", "block", F.col("a").alias("print"))
    # every two blocks of a heavy cell meet in one group of at most HEAVY prints
    sizes = heavy.groupBy("grid", "cell").agg(F.max("block").alias("last"))
    pairs = heavy.join(sizes, ["grid", "cell"]).select(
        "grid", "cell", "block", "print", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    pairs = pairs.select("grid", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, low, high, block, own), starts in _groups(batches, 4):
            own = own.view(np.uint64)
            a, b = [], []
            for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(own)]):
                members = own[s:t]
                for root, rest in _stars(members, most, None if low[s] == high[s] else block[s:t]):
                    a.append(np.full(len(rest), members[root]))
                    b.append(members[rest])
            yield pa.RecordBatch.from_arrays(list(_links(a, b)), ["a", "b"])

    met = pairs.repartition("grid", "cell", "low", "high").sortWithinPartitions("grid", "cell", "low", "high").mapInArrow(compare, "a long, b long")
    return found.filter("block is null").select("a", "b").union(met)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, blocks: int = BLOCKS, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints with at most ``most`` differing bits are linked; component_id is the smallest doc_id
    of the documents that links lead to (null ids count as the largest), and of each component one row
    is kept. Texts without words, null ones included, have fingerprint zero and are linked like any
    other. An empty table gives no rows.
    """
    sketches = stored(fingerprints(docs, shingle, row))
    first = F.struct(rank_last(F.col("doc_id")).alias("rank"), "row")
    prints = stored(sketches.groupBy("print").agg(F.min(first).alias("first")))
    roots = components(near_links(prints.select("print"), most, blocks))
    placed = stored(prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    placed = placed.join(least, "root").select("print", "least")
    return sketches.join(placed, "print").select(
        "row", "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least.rank.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
