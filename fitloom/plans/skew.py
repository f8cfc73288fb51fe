"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that hold more than one row in so many are heavy; so fewer keys than this can be.
PARTS = 1024


def heavy_keys(table: DataFrame, weight: str, total: Column | int, parts: int = PARTS) -> DataFrame:
    """Rows of ``table`` whose ``weight`` is over ``total / parts``: fewer than ``parts`` rows, as long
    as the weights add up to ``total`` at most."""
    total = F.lit(total) if isinstance(total, int) else total
    return table.filter(F.col(weight) * F.lit(parts) > total)


def join_by_weight(rows: DataFrame, table: DataFrame, on: str, weight: str, total: int, parts: int = PARTS) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key ``on`` and in ``weight`` how many rows hold it.

    Heavy keys are broadcast, so that no task has to take all rows of one; all others are shuffled
    and none of them holds more than ``total / parts`` rows. Both sides are read twice: pass stored
    tables. Rows with a null key or without a match don't come back.
    """
    heavy = heavy_keys(table, weight, total, parts)
    light = table.filter(F.col(weight) * F.lit(parts) <= F.lit(total))
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))
