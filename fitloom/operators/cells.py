"""Vectors in cells around pivots, so that most cells can be left out by the triangle inequality.

An angle is a distance: no vector of a cell is closer to a query than the query's angle to the pivot
less the cell's radius. With the longest vector of the cell that bounds every dot product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.plans.materialize import cut

# Pivots at most: they are taken from the table by hash and broadcast.
PIVOTS = 256
# Rows of one side that a task compares at a time.
ROWS = 4096
# Slack of angles in radians: beyond the rounding of an arc cosine near 1.
LOOSE = 1e-6


class Facts(NamedTuple):
    """Of every cell: pivot (unit vector), radius, longest vector, rows."""

    pivots: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    rows: np.ndarray


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms == 0, 1.0, norms)[:, None], norms


def placed(df: DataFrame, id_: str, vector: str, pivots: int = PIVOTS) -> tuple[DataFrame, Facts]:
    """A stored table (id, vector, cell) of ``df``, which is stored too, and the facts of its cells.

    The square root of the number of rows, ``pivots`` at most, is how many pivots there are. Rows without a
    vector are left out.
    """
    rows = df.select(id_, vector).filter(F.col(vector).isNotNull())
    count = min(pivots, max(1, int(rows.count() ** 0.5)))
    chosen = rows.orderBy(F.xxhash64(id_), id_).limit(count).collect()
    if not chosen:
        return rows.withColumn("cell", F.lit(0)), Facts(np.zeros((0, 1)), *[np.zeros(0)] * 3)
    centres = units(np.array([r[vector] for r in chosen], np.float64))[0]
    sent = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit, norms = units(matrix(batch[vector]))
                near = unit @ sent.value.T
                cell = near.argmax(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(near.max(axis=1), -1, 1)), norm=norms)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (id_, vector))
    table = cut(rows.mapInPandas(place, f"{kinds}, cell int, angle double, norm double"))
    found = {r["cell"]: r for r in table.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("longest"), F.count("*").alias("rows")).collect()}
    of = lambda name: np.array([found[c][name] if c in found else 0 for c in range(len(centres))], np.float64)
    return table.drop("angle", "norm"), Facts(centres, of("radius"), of("longest"), of("rows"))


def bounds(x: np.ndarray, facts: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the queries, and the largest dot product that each may have with a vector of each cell (0
    where only negative ones are left)."""
    unit, norms = units(x)
    angle = np.arccos(np.clip(unit @ facts.pivots.T, -1, 1)) - facts.radius - LOOSE
    return norms, np.where(facts.rows > 0, np.maximum(np.cos(np.clip(angle, 0, np.pi)), 0.0) * norms[:, None] * facts.longest, -np.inf)


def visits(queries: DataFrame, id_: str, vector: str, facts: Facts, least: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, *extra: str) -> DataFrame:
    """(id, vector, extra, cell) of every cell whose bound reaches what the column ``extra`` or else
    ``least(norms, bounds)`` asks for."""
    sent = queries.sparkSession.sparkContext.broadcast(tuple(facts))
    columns = [id_, vector, *extra]

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at:at + 1024]
                norms, most = bounds(matrix(part[vector]), Facts(*sent.value))
                asked = part[extra[0]].to_numpy()[:, None] if extra else least(norms, most)
                row, cell = np.nonzero((most >= asked) & (most > -np.inf))
                yield part.iloc[row].assign(cell=cell.astype(np.int32))

    rows = queries.select(*columns).filter(F.col(vector).isNotNull())
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInPandas(reach, f"{kinds}, cell int")


def meet(visits: DataFrame, table: DataFrame, facts: Facts, rows: int, compare: Callable, schema: str) -> DataFrame:
    """``compare`` on the visitors and the vectors of every cell, both in parts of about ``rows`` rows.

    A cell of many vectors is many tasks; each of its visitors goes to all of them.
    """
    spark = table.sparkSession
    number = spark.createDataFrame([(c, max(1, -(-int(n) // rows))) for c, n in enumerate(facts.rows)] or [(0, 1)], "cell int, parts int")
    came = visits.withColumn("visitor", F.pmod(F.xxhash64(visits.columns[0]), F.lit(1 << 30)))
    crowd = cut(came)
    guests = crowd.groupBy("cell").agg(F.count("*").alias("guests")).join(F.broadcast(number), "cell").select(
        "cell", "parts", F.ceil(F.col("guests") / rows).cast("int").alias("shares"))
    guests = F.broadcast(guests)  # one row per cell
    left = crowd.join(guests, "cell").withColumn("share", F.pmod("visitor", "shares").cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("visitor", "parts", "shares")
    home = F.pmod(F.xxhash64(table.columns[0], F.lit(1)), F.col("parts")).cast("int")
    right = table.join(guests, "cell").withColumn("part", home).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("parts", "shares")
    keys = ["cell", "part", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
