"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated onto the main axes of the data and the coordinates dealt to blocks of about
equal spread. Cosine c means squared distance 2 - 2c; it is the sum over the blocks, so a pair within
it is, in one block at least, within the block's share of it. Each block is therefore a range join of
its own over a grid on its leading coordinates. A pair counts in the first block that is within its
share, which both vectors tell by themselves, so the union needs no second pass; its cosine is then
taken from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Shipped, row_id, stored
from fitloom.llm.components import components

BLOCKS = 4
GRID_AXES = 2
# Own vectors of a cell in one task, about, and visitors that it holds at a time.
TASK_ROWS = 2048
COSINE = 0.93
# Room for rounding in the rotated coordinates; the exact cosine decides.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls and of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their group of equal vectors, and one vector per group.

    rows: row, vec_id, rep (null for vectors that link with nothing). reps: rep, label, dim, vector,
    size. Equal vectors with one label are one group, named by the smallest row.
    """
    rows = vectors.select(row_id().alias("row"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    # adding zero makes -0.0 and 0.0 equal; a sum over absent or non-finite parts is null or non-finite
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    usable = F.col("label").isNotNull() & size.isNotNull() & (size > 0) & (size < float("inf"))
    rows = stored(rows.withColumn("usable", F.coalesce(usable, F.lit(False))))
    groups = rows.filter("usable").groupBy("label", "vector").agg(F.min("row").alias("rep"), F.count("*").alias("size"))
    groups = stored(groups)
    named = rows.filter("usable").join(groups.select("label", "vector", "rep"), ["label", "vector"]).select("row", "vec_id", "rep")
    named = named.union(rows.filter("not usable").select("row", "vec_id", F.lit(None).cast("long")))
    return named, groups.select("rep", "label", F.size("vector").alias("dim"), "vector", "size")


def main_axes(reps: DataFrame) -> np.ndarray:
    """Main axes of the unit vectors of the most frequent length, strongest first.

    Tasks send sums of products, dim x dim numbers each, which Spark adds up.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total = x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    dims = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return np.zeros((0, 0))
    parts = reps.filter(F.col("dim") == dims[0]).select("vector").mapInArrow(sums, "at int, v double")
    total = np.zeros(dims[0] ** 2)
    for row in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[row["at"]] = row["v"]
    _, axes = np.linalg.eigh(total.reshape(dims[0], dims[0]))
    return axes[:, ::-1]


class Blocks:
    """Rotation, the coordinates of each block, and its share of the squared distance."""

    def __init__(self, axes: np.ndarray, cosine: float, blocks: int, grid_axes: int):
        dim = len(axes)
        self.axes, self.cosine = axes, cosine
        blocks = max(1, min(blocks, dim))
        self.parts = [np.arange(k, dim, blocks) for k in range(blocks)]
        self.budgets = [(2 - 2 * cosine) * len(p) / max(dim, 1) + SLACK for p in self.parts]
        self.grid = [p[:grid_axes] for p in self.parts]

    def rotated(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        # vectors of another length share no pair with these; they are taken as they are
        return unit, unit @ self.axes if unit.shape[1] == len(self.axes) else unit

    def cells(self, turned: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell of every vector, and all cells that a vector within the budget can be in. Cells are
        four radii wide, so most vectors reach one or two per axis."""
        grid = self.grid[block][self.grid[block] < turned.shape[1]]
        radius = np.sqrt(self.budgets[block])
        width = 4 * radius
        x = turned[:, grid]
        own = np.floor(x / width).astype(np.int64)
        low, high = np.floor((x - radius) / width), np.floor((x + radius) / width)
        reach = []
        for offset in product((0, 1), repeat=x.shape[1]):
            cell = np.where(np.array(offset, bool), high, low).astype(np.int64)
            # where low and high agree the second one is the same cell again
            again = ((low == high) & np.array(offset, bool)).any(1)
            cell = np.concatenate([cell, again[:, None].astype(np.int64)], 1)
            reach.append(cell)
        return own, reach


def _code(cells: np.ndarray) -> np.ndarray:
    """One number per cell of a grid; coordinates of unit vectors keep every axis within 16 bits."""
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = out << 16 | (cells[:, k] + (1 << 15))
    return out


def link_counts(reps: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid_axes: int = GRID_AXES) -> DataFrame:
    """rep, links, other: links adds up, over a rep's rows, to the number of vectors in other groups that
    are linked to it; other is a rep that it is connected with, or null."""
    plan = Shipped(reps.sparkSession, Blocks(main_axes(reps), cosine, blocks, grid_axes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = {n: i for i, n in enumerate(batch.schema.names)}
            dims = batch.column(index["dim"]).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                _, turned = plan.value.rotated(_matrix(some.column(index["vector"])))
                for block in range(len(plan.value.parts)):
                    own, reach = plan.value.cells(turned, block)
                    places = [(True, _code(own), np.arange(len(own)))]
                    for cell in reach:
                        here = np.flatnonzero(cell[:, -1] == 0)
                        places.append((False, _code(cell[here, :-1]), here))
                    for home, cell, here in places:
                        rows = some.take(pa.array(here))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(index[c]) for c in ("rep", "label", "dim", "size", "vector")]
                            + [pa.array(np.full(len(here), block, np.int32)), pa.array(cell), pa.array(np.full(len(here), home))],
                            ["rep", "label", "dim", "size", "vector", "block", "cell", "home"])

    kind = reps.schema["label"].dataType.simpleString()
    dealt = stored(reps.mapInArrow(
        deal, f"rep long, label {kind}, dim int, size long, vector array<double>, block int, cell long, home boolean"))
    place = ["label", "dim", "block", "cell"]
    # cells without a vector of their own compare nothing; large ones are split by their own vectors
    sizes = dealt.filter("home").groupBy(*place).agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("tasks"))
    spread = dealt.join(sizes, place).withColumn("task", F.explode(F.when(
        F.col("home"), F.array(F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int")))
        .otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))))

    most = TASK_ROWS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _tasks(batches, most):
            yield _compared(group, plan.value)

    keys = [*place, "task"]
    ordered = spread.select(*keys, "home", "rep", "size", "vector").repartition(*keys).sortWithinPartitions(*keys, F.desc("home"))
    return ordered.mapInArrow(compare, "rep long, links long, other long")


def _tasks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Own rows of one task after the other with at most ``most`` of its visitors at a time, from batches
    sorted by task, own rows first. Tasks without visitors compare nothing."""
    mine: list[pa.RecordBatch] = []
    visitors: list[pa.RecordBatch] = []
    held, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        # the sixth column is home: runs of own rows and of visitors come one by one
        for i in range(6):
            values = batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, batch.num_rows]):
            now = tuple(batch.column(i)[a].as_py() for i in range(5))
            if now != last:
                if visitors:
                    yield pa.Table.from_batches([*mine, *visitors])
                mine, visitors, held, last = [], [], 0, now
            if batch.column(5)[a].as_py():
                mine.append(batch.slice(a, b - a))
                continue
            while a < b:
                some = batch.slice(a, min(b - a, most - held))
                visitors.append(some)
                held += some.num_rows
                a += some.num_rows
                if held == most:
                    yield pa.Table.from_batches([*mine, *visitors])
                    visitors, held = [], 0
    if visitors:
        yield pa.Table.from_batches([*mine, *visitors])


def _compared(table: pa.Table, plan: Blocks) -> pa.RecordBatch:
    """Counts for the cell's own vectors against the visitors at hand, and links that connect them."""
    home = table.column("home").to_numpy()
    rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    block = table.column("block")[0].as_py()
    unit, turned = plan.rotated(vectors)
    mine, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    links = np.zeros(len(mine), np.int64)
    root = np.arange(len(table))  # of a forest over all rows; small numbers are roots

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(mine), 256):
        some = mine[at:at + 256]
        for start in range(0, len(visitors), 4096):
            others = visitors[start:start + 4096]
            i, j = np.nonzero(unit[some] @ unit[others].T >= plan.cosine - SLACK)
            keep = rep[some[i]] != rep[others[j]]
            i, j = i[keep], j[keep]
            for low in range(0, len(i), 1 << 15):
                a, b = some[i[low:low + (1 << 15)]], others[j[low:low + (1 << 15)]]
                ok = _first_block(turned, a, b, plan, block)
                a, b = a[ok], b[ok]
                x, y = vectors[a], vectors[b]
                exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                a, b = a[exact >= plan.cosine], b[exact >= plan.cosine]
                np.add.at(links, np.searchsorted(mine, a), size[b])
                # one link from each row to the smallest row it met in this part is enough for a forest
                for c, d in _spanning(a, b):
                    c, d = find(c), find(d)
                    root[max(c, d)] = min(c, d)
    ends = np.array([find(i) for i in range(len(root))], np.int64)
    moved = np.flatnonzero((ends != np.arange(len(root))) & (rep[ends] != rep))
    mine, links = mine[links > 0], links[links > 0]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((rep[mine], rep[moved]))), pa.array(np.concatenate((links, np.zeros(len(moved), np.int64)))),
         pa.array([None] * len(mine) + rep[ends[moved]].tolist(), pa.int64())], ["rep", "links", "other"])


def _first_block(turned: np.ndarray, a: np.ndarray, b: np.ndarray, plan: Blocks, block: int) -> np.ndarray:
    """Whether ``block`` is the first one in which a pair is within the block's share."""
    gap = (turned[a] - turned[b]) ** 2
    within = [gap[:, p[p < gap.shape[1]]].sum(1) <= budget for p, budget in zip(plan.parts[:block + 1], plan.budgets)]
    return within[block] & ~np.any(within[:block], axis=0) if block else within[0]


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the pairs connect, far fewer than the pairs: labels spread along them."""
    if len(a) < 64:
        return list(zip(a.tolist(), b.tolist()))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return list(zip(nodes.tolist(), nodes[label].tolist()))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid_axes: int = GRID_AXES) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths agree, by cosine
    in double precision. A vector that is null, empty, zero, or holds null or non-finite parts links
    with nothing: it has no links and is its own component. component_id is the smallest vec_id
    reachable by links, itself included (null ids count as the largest). Repeated rows link with each
    other. An empty table gives no rows.
    """
    rows, reps = distinct_vectors(vectors)
    rows, reps = stored(rows), stored(reps)
    found = stored(link_counts(reps, cosine, blocks, grid_axes))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = reps.select("rep", "size").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    placed = stored(placed)
    members = rows.join(placed, "rep", "left")
    # missing ids sort after all others
    rank = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))
    least = rows.join(placed.select("rep", "root"), "rep").groupBy("root").agg(F.min(rank).alias("least"))
    return members.join(least, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("least.id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("least.id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
