"""The SimHash operator with fingerprints of several words, for similarities that 64 bits can't tell apart.

A text has four 64-bit fingerprints of its distinct five-word shingles. Of two texts with a Jaccard similarity of 0.8
some 39 of the 256 bits differ, give or take six. As in `simhash`, bit counts of two-bit segments are a
point whose Manhattan distance bounds the differing bits. Grids of a few segments each are chosen at random,
as many as it takes for a pair at the bound to share a cell almost surely; points of a cell are compared by
that bound and then exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import pieces, rank_last, row_id, stored, text_buffer
from fitloom.llm.components import components
from fitloom.llm.simhash import SEED, _embedded, _groups, bit_table, embedded

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 4
# Share of the pairs at the bound that the grids may miss.
MISSED = 0.03
# Points that a cell has on average, about, by chance.
CROWD = 256
# Cells of more points are compared block by block in tasks of their own; fewer are compared all at once.
HEAVY, HALF, FEW = 4096, 2048, 16
BYTES = 2 << 20
# Texts whose bits are counted at a time: 8 MB.
TEXTS = 512
PRINTS = [f"p{k}" for k in range(WORDS)]
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def flip_rate(similarity: float) -> float:
    """Share of bits in which two sets of equal size and this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_bits(similarity: float = SIMILARITY) -> int:
    """Bits that may differ: the expected number at the similarity asked for, and half a deviation more."""
    p = flip_rate(similarity)
    n = 64 * WORDS
    return int(n * p + 0.5 * (n * p * (1 - p)) ** 0.5)


def grids(rows: int, similarity: float = SIMILARITY, missed: float = MISSED) -> list[tuple[int, int]]:
    """(word, signed mask) of every grid: more segments to a key the more rows there are, and then more grids."""
    p = flip_rate(similarity)
    agree = (1 - p) ** 2 + p * p / 2  # both bits stay, or change places
    size = min(32, max(8, ceil(log(max(1, rows) / CROWD) / log(8 / 3))))
    count = ceil(log(missed) / log(1 - agree ** size))
    random, out = np.random.RandomState(5), []
    for g in range(count):
        mask = sum(3 << 2 * int(s) for s in random.choice(32, size, replace=False))
        out.append((g % WORDS, mask - (1 << 64) if mask >> 63 else mask))
    return out


def _prints(texts: list[bytes], shingle: int) -> np.ndarray:
    """(texts, WORDS) fingerprints; zero for a text without words."""
    hashes, owner = [], []
    for k, text in enumerate(texts):
        text = b" ".join(text.lower().split())
        if not text:
            continue
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(text)]
        own = {xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])} if len(ends) > shingle else {
            xxhash.xxh64_intdigest(text, SEED)}
        hashes += own
        owner.append((k, len(own)))
    out = np.zeros((len(texts), WORDS), np.uint64)
    if not hashes:
        return out
    row, counts = np.array(owner).T
    first = np.array(hashes, np.uint64)
    ends = np.cumsum(counts)
    for at in range(0, len(row), TEXTS):
        own = slice(at, at + TEXTS)
        some = first[(ends[at] - counts[at]):ends[own][-1]]
        for w in range(WORDS):
            mixed = (some ^ some >> np.uint64(29)) * MIX[w]
            mixed ^= mixed >> np.uint64(32)
            set_ = 2 * _bit_sums(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), counts[own]) > counts[own, None]
            out[row[own], w] = np.packbits(set_, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
    return out


def _bit_sums(raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 64): how many of a text's numbers, eight bytes each, have each bit."""
    if len(raw) < 32 * len(counts):
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    # many numbers: count the bytes first
    place = np.repeat(np.arange(len(counts)) * 2048, counts)[:, None] + np.arange(0, 2048, 256) + raw
    seen = np.bincount(place.ravel(), minlength=2048 * len(counts)).reshape(-1, 256)
    return (seen.astype(float) @ bit_table().astype(float)).reshape(len(counts), 64)


def wide_prints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """row, doc_id, p0 ... p3 of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", BYTES):
                raw, offsets = text_buffer(piece.column(2))
                found = _prints([raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], shingle)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T)], ["row", "doc_id", *PRINTS])

    frame = docs.select((row_id() if row is None else row).alias("row"), "doc_id", "text")
    kinds = [frame.schema[c].dataType.simpleString() for c in ("row", "doc_id")]
    return frame.mapInArrow(run, f"row {kinds[0]}, doc_id {kinds[1]}, " + ", ".join(f"{p} long" for p in PRINTS))


def _close(prints: np.ndarray, points: np.ndarray, some: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are near, by the lower bound and then exactly."""
    near = np.bitwise_count(points[some][:, None] ^ points[others]).sum(-1) <= most
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(prints[some[i]] ^ prints[others[j]]).sum(-1) <= most
    return near


def _stars(prints: np.ndarray, most: int, side: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """Components of the prints, each as its first member and the rest; with ``side``, of links between the sides."""
    points = _embedded(prints)
    left, out = np.arange(len(prints)), []
    while len(left):
        root, left = left[0], left[1:]
        edge, reached = np.array([root]), []
        while len(edge) and len(left):
            some, edge = edge[:32], edge[32:]
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


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (a, b)]


def _wide(columns: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.ascontiguousarray(c).view(np.uint64) for c in columns])


def near_links(prints: DataFrame, rows: int, similarity: float = SIMILARITY, missed: float = MISSED) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (node, p0 ... p3) within `most_bits` that share a cell.

    From a cell only as many links leave as keep its near nodes connected.
    """
    most = most_bits(similarity)
    cell = [embedded(F.col(PRINTS[w])).bitwiseAND(F.lit(m)) for w, m in grids(rows, similarity, missed)]
    cells = prints.select("node", *PRINTS, F.posexplode(F.array(*cell)).alias("grid", "cell")).select("grid", "cell", "node", *PRINTS)
    out = "a long, b long, grid int, cell long, block int, " + ", ".join(f"{p} long" for p in PRINTS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grid, cell, node, *words), starts in _groups(batches, 2):
            own = _wide(words)
            sizes = np.diff(np.append(starts, len(node)))
            group = np.repeat(np.arange(len(starts)), sizes)
            few = np.flatnonzero(sizes[group] <= FEW)
            small, p, e, who = group[few], own[few], _embedded(own[few]), node[few]
            a, b, big = [], [], []
            for step in range(1, FEW):
                same = np.flatnonzero(small[step:] == small[:-step])
                if not len(same):
                    break
                same = same[np.bitwise_count(e[same] ^ e[same + step]).sum(-1) <= most]
                same = same[np.bitwise_count(p[same] ^ p[same + step]).sum(-1) <= most]
                a.append(who[same])
                b.append(who[same + step])
            for g in np.flatnonzero(sizes > FEW).tolist():
                part = slice(starts[g], starts[g] + sizes[g])
                if sizes[g] > HEAVY:
                    big.append(part)
                    continue
                for root, rest in _stars(own[part], most):
                    a.append(np.full(len(rest), node[part][root]))
                    b.append(node[part][rest])
            left, right = _pairs(a, b)
            none = pa.nulls(len(left), pa.int64())
            yield pa.RecordBatch.from_arrays([left, right, none.cast(pa.int32()), none, none.cast(pa.int32()), *[none] * WORDS],
                                             ["a", "b", "grid", "cell", "block", *PRINTS])
            for part in big:
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[part]), pa.nulls(n, pa.int64()), pa.array(grid[part].astype(np.int32)), pa.array(cell[part]),
                     pa.array((np.arange(n) // HALF).astype(np.int32)), *(pa.array(w[part]) for w in words)], ["a", "b", "grid", "cell", "block", *PRINTS])

    found = stored(cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "node").mapInArrow(scan, out))
    heavy = found.filter("block is not null").drop("b").withColumnRenamed("a", "node")
    last = heavy.groupBy("grid", "cell").agg(F.max("block").alias("last"))
    # every two blocks of a heavy cell meet in one group of at most HEAVY nodes
    pairs = heavy.join(last, ["grid", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = pairs.select("grid", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", *PRINTS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, low, high, block, node, *words), starts in _groups(batches, 4):
            own, a, b = _wide(words), [], []
            for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                for root, rest in _stars(own[s:t], most, None if low[s] == high[s] else block[s:t]):
                    a.append(np.full(len(rest), node[s:t][root]))
                    b.append(node[s:t][rest])
            yield pa.RecordBatch.from_arrays(_pairs(a, b), ["a", "b"])

    keys = ["grid", "cell", "low", "high"]
    met = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")
    return found.filter("block is null").select("a", "b").union(met)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, missed: float = MISSED, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, component_id, kept.

    Texts whose wide fingerprints differ in at most `most_bits` bits are linked, if a grid brings them together: all but
    ``missed`` of the pairs at the bound, nearly all closer ones. Words are those of `simhash`. component_id is the smallest
    doc_id that links lead to (null ids count as the largest); of each component one row is kept, ties by place.
    Texts without words, null ones included, are near copies of each other. Repeated rows are near copies; an empty table gives no rows.
    """
    sketches = stored(wide_prints(docs, shingle, row))
    first = F.struct(rank_last(F.col("doc_id")).alias("rank"), "row")
    distinct = sketches.groupBy(*PRINTS).agg(F.min(first).alias("first"))
    prints = stored(distinct.withColumn("node", row_id()))
    roots = components(near_links(prints.select("node", *PRINTS), prints.count(), similarity, missed))
    placed = stored(prints.join(roots, "node", "left").select(*PRINTS, "first", F.coalesce("root", "node").alias("root")))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    return sketches.join(placed.join(least, "root").select(*PRINTS, "least"), PRINTS).select(
        "row", "doc_id", F.col("least.rank.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("kept"))
