"""Nearest groups (E7) and chosen pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions.vectors import dot
from fitloom.operators import cells
from fitloom.plans.materialize import cut

# A similarity is rounded to six digits, so a cell that is this much below may still hold a tie.
ROUNDING = 2e-6


def _top(k: int, query: str, group: str):
    """For `cells.meet`: the k best groups of every visitor of a cell; of equal ones those of the lower id."""
    def compare(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "group_id": [], "similarity": []})
        b = b.sort_values("group_id")
        ids, vectors = b["group_id"].to_numpy(), cells.matrix(b["vector"])
        out = []
        for at in range(0, len(a), 1024):
            part = a.iloc[at:at + 1024]
            sims = np.round(cells.matrix(part["vector"]) @ vectors.T, 6)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), order.shape[1]), "group_id": ids[order].ravel(),
                                     "similarity": sims[np.arange(len(part))[:, None], order].ravel()}))
        return pd.concat(out)
    return compare, f"query_id {query}, group_id {group}, similarity double"


def _first_cells(facts: cells.Facts, k: int):
    """Asks for the bound of the last of the best cells that together hold k groups."""
    def least(norms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        order = np.argsort(-bounds, axis=1, kind="stable")
        enough = (np.cumsum(facts.rows[order], axis=1) >= k).argmax(axis=1)
        enough[facts.rows.sum() < k] = len(facts.rows) - 1
        return np.take_along_axis(np.take_along_axis(bounds, order, 1), enough[:, None], 1)
    return least


def nearest_groups(queries: DataFrame, groups: DataFrame, k: int = 3, pivots: int = cells.PIVOTS, block_rows: int = cells.ROWS,
                   on_visits: Callable[[DataFrame, cells.Facts], None] | None = None) -> DataFrame:
    """(query_id, group_id, similarity, rank), the k most similar groups of every query, exact.

    ``queries``: (query_id, vector), ``groups``: (group_id, vector), ids unique. Groups lie in cells around
    pivots. Every query first visits the best cells that hold k groups, then, with its k-th best similarity as the
    least, all others that may hold a better one. ``block_rows`` rows of each side meet in one task at
    a time. ``on_visits`` gets the table of the second visits (one row per query and cell) and the facts of
    the cells, so that callers can see what was left out. Rows without a vector are left out.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (groups, "group_id"))]
    compare, schema = _top(k, *kinds)
    table, facts = cells.placed(groups, "group_id", "vector", pivots)
    asked = cut(queries.select("query_id", "vector").filter("vector is not null"))
    if not len(facts.rows):
        return asked.sparkSession.createDataFrame([], f"{schema}, rank int")
    best = lambda n: F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "group_id"))), 1, n)
    first = cells.visits(asked, "query_id", "vector", facts, _first_cells(facts, k))
    seen = cells.meet(first, table, facts, block_rows, compare, schema).groupBy("query_id").agg(best(k).alias("best"))
    # with fewer than k groups seen there is no bound yet
    bound = F.when(F.size("best") >= k, -F.element_at("best", -1)["far"] - ROUNDING).otherwise(F.lit(-1e300))
    bounded = cut(asked.join(seen.select("query_id", bound.alias("bound")), "query_id"))
    second = cut(cells.visits(bounded, "query_id", "vector", facts, None, "bound").drop("bound"))
    if on_visits is not None:
        on_visits(second, facts)
    found = cells.meet(second, table, facts, block_rows, compare, schema).groupBy("query_id").agg(best(k).alias("best"))
    return found.select("query_id", F.posexplode("best")).select(
        "query_id", "col.group_id", (-F.col("col.far")).alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Similarity of chosen pairs (a, b) of keys; ``vectors`` is (key, vector)."""
    left = vectors.select(F.col("key").alias("a"), F.col("vector").alias("va"))
    right = vectors.select(F.col("key").alias("b"), F.col("vector").alias("vb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity")))
