"""Helpers that keep costly expressions from being computed more than once.

Spark evaluates an expression again at every place it is written inside a lambda, and a filter on
a computed column again below the projection.  ``let`` and ``keep_rows`` give such a value a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_rows(df: DataFrame, made: dict[str, Column], keep: Callable[[Column], Column]) -> DataFrame:
    """``df.withColumns(made)`` where ``keep`` holds, without computing ``made`` twice.

    ``keep`` gets the computed columns as a struct.  All other columns stay outside of it, so that
    unused ones are pruned and filters on them reach the scan.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    rows = F.filter(F.array(F.struct(*[c.alias(n) for n, c in made.items()])), keep)
    return df.select(*rest, F.inline(rows)).select(*df.columns, *[n for n in made if n not in df.columns])


def ordered_distinct(items: Column, key: Callable[[Column], Column], limit: int | None = None) -> Column:
    """First item per key, in order, optionally the first ``limit`` of them."""
    def pick(items, keys):
        unique = F.array_distinct(keys)
        if limit is not None:
            unique = F.slice(unique, 1, limit)
        return F.transform(unique, lambda k: F.get(items, (F.array_position(keys, k) - 1).cast("int")))
    return let(items, lambda i: let(F.transform(i, lambda x: key(x)), lambda k: pick(i, k)))


def range_part(value: Column, cuts: Column, parts: int) -> Column:
    """Which of ``parts`` ranges a value lies in: how many of the sorted ``cuts`` are at most the value.

    Nulls are in the first range. Never null: an inferred null check would run the search on every row
    below an aggregate.
    """
    steps = F.lit([1 << b for b in reversed(range(parts.bit_length()))])

    def search(at, step):
        nxt = at + step
        return F.when(F.try_element_at(cuts, nxt) <= value, nxt).otherwise(at)

    return F.coalesce(F.aggregate(steps, F.lit(0), search), F.lit(0))
