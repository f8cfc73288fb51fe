"""Similarity joins of names (F2): all pairs whose vectors have a dot product of at least a threshold.

Names become sparse vectors of hashed words (`prefix_pairs`, in column expressions only) or dense
vectors of any encoder (`pivot_pairs`). Both find every pair: what they leave out can't reach the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.arrays import let
from fitloom.functions.vectors import Encoder, HashingEncoder, embed
from fitloom.operators import cells
from fitloom.plans.materialize import cut

# Similarities are rounded to six digits, and float vectors are a little longer than one.
SLACK = 1e-5
OUT = ["left_name", "right_name", "similarity"]


def similar_names(left: DataFrame, right: DataFrame, threshold: float, make_encoder: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """(left_name, right_name, similarity) of all distinct names that are at least ``threshold`` (above 0) similar.

    Both sides have a column ``name``; null names are similar to nothing.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 makes every pair similar")
    sides = [df.select("name").filter("name is not null").distinct() for df in (left, right)]
    if hasattr(make_encoder, "counts"):
        return prefix_pairs(*sides, threshold, make_encoder)
    return pivot_pairs(*sides, threshold, make_encoder)


# --- sparse vectors: the first two shared words -----------------------------------------------

def _sparse(names: DataFrame, encoder: type[HashingEncoder]) -> DataFrame:
    """id, name, v: (slot, weight) of the slots that a name uses; weights as the dense vector has them."""
    entries = F.filter(F.transform(encoder.column(F.col("name")), lambda w, i: F.struct(i.alias("slot"), w.cast("double").alias("w"))),
                       lambda e: e["w"] != 0)
    return cut(names.select(F.monotonically_increasing_id().alias("id"), "name", entries.alias("v")).filter(F.size("v") > 0))


def _ranked(v: Column, order: list[int]) -> Column:
    """(rank, w, rest): slots in the order of their ranks, with the squared weight from each one on."""
    ranks = F.array(*map(F.lit, order))
    placed = F.sort_array(F.transform(v, lambda e: F.struct(F.get(ranks, e["slot"]).alias("rank"), e["w"].alias("w"))))

    def rests(v):
        rest = lambda i: F.aggregate(F.slice(v, i + 1, F.size(v)), F.lit(0.0), lambda s, e: s + e["w"] * e["w"])
        return F.transform(v, lambda e, i: F.struct(e["rank"].alias("rank"), e["w"].alias("w"), rest(i).alias("rest")))
    return let(placed, rests)


def _keys(v: Column, dim: int, least: float) -> Column:
    """Keys under which a vector meets those that may reach ``least`` with it: (key, wa, wb, rest).

    Vectors that share one slot only need a weight of ``least`` there. Of those that share more, the first two
    shared slots a < b have wa wa' + wb wb' + rest rest' >= least, so on each side the
    largest weight before b and all from b on are at least as long; nothing beyond such a b is needed.
    """
    alone = F.transform(F.filter(v, lambda e: e["w"] >= least), lambda e: F.struct(
        (-1 - e["rank"]).cast("long").alias("key"), e["w"].alias("wa"), F.lit(0.0).alias("wb"), F.lit(0.0).alias("rest")))

    def pairs(b, i):
        before = F.slice(v, 1, i)
        far = F.array_max(F.transform(before, lambda a: a["w"]))
        made = F.transform(before, lambda a: F.struct(
            (a["rank"].cast("long") * dim + b["rank"]).alias("key"), a["w"].alias("wa"), b["w"].alias("wb"),
            F.sqrt(F.greatest(b["rest"] - b["w"] * b["w"], F.lit(0.0))).alias("rest")))
        return F.when(far * far + b["rest"] >= least * least, made)

    return F.concat(alone, F.flatten(F.array_compact(F.transform(v, lambda b, i: F.when(i > 0, pairs(b, i))))))


def prefix_candidates(left: DataFrame, right: DataFrame, threshold: float, dim: int) -> DataFrame:
    """(left_id, right_id) of all pairs that may reach the threshold; both sides are tables of `_sparse`.

    Slots are ordered by how few names use them, so most names meet under rare words. The order is
    one number per slot on the driver, ``dim`` of them.
    """
    least = threshold - SLACK
    slots = left.select(F.explode("v.slot").alias("slot")).union(right.select(F.explode("v.slot").alias("slot")))
    used = {r["slot"]: r["n"] for r in slots.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    order = np.argsort(sorted(range(dim), key=lambda s: used.get(s, 0))).tolist()

    def side(df, name):
        keys = df.select(F.col("id").alias(name), _ranked(F.col("v"), order).alias("v")).select(name, F.explode(let(F.col("v"), lambda v: _keys(v, dim, least))).alias("k"))
        return keys.select(name, "k.key", F.struct("k.wa", "k.wb", "k.rest").alias(name[0]))

    # a small table of names has many keys, which its stored size doesn't tell: never broadcast
    met = side(left, "left_id").join(side(right, "right_id").hint("merge"), "key")
    reach = F.col("l.wa") * F.col("r.wa") + F.col("l.wb") * F.col("r.wb") + F.col("l.rest") * F.col("r.rest")
    return met.filter(reach >= least).select("left_id", "right_id").distinct()


def prefix_pairs(left: DataFrame, right: DataFrame, threshold: float, encoder: type[HashingEncoder] = HashingEncoder) -> DataFrame:
    """`similar_names` of hashed words: a join on the first two shared slots, then the dot product."""
    left, right = _sparse(left, encoder), _sparse(right, encoder)
    found = prefix_candidates(left, right, threshold, encoder.dim)
    by_slot = F.map_from_entries(F.transform("v", lambda e: F.struct(e["slot"], e["w"])))
    both = found.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), "v"), "left_id").join(
        right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), by_slot.alias("other")), "right_id")
    dot = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at("other", e["slot"]), F.lit(0.0)))
    return both.select("left_name", "right_name", F.round(dot, 6).alias("similarity")).filter(F.col("similarity") >= threshold)


# --- dense vectors: cells around pivots -------------------------------------------------------

def pivot_pairs(left: DataFrame, right: DataFrame, threshold: float, make_encoder: Callable[[], Encoder],
                pivots: int = cells.PIVOTS, rows: int = cells.ROWS) -> DataFrame:
    """`similar_names` of any encoder: right names lie in cells around pivots, and a left name visits the cells
    that its angle to the pivot, less the cell's radius, lets it reach."""
    left, right = (cut(df.select("name", embed(F.col("name"), make_encoder).alias("v"))) for df in (left, right))
    placed, facts = cells.placed(right, "name", "v", pivots)
    visits = cells.visits(left, "name", "v", facts, lambda norms, bounds: np.broadcast_to(threshold - SLACK, bounds.shape))

    def compare(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in OUT})
        sims = np.round(cells.matrix(a["v"]) @ cells.matrix(b["v"]).T, 6)
        i, j = np.nonzero(sims >= threshold)
        return pd.DataFrame({"left_name": a["name"].to_numpy()[i], "right_name": b["name"].to_numpy()[j], "similarity": sims[i, j]})

    return cells.meet(visits, placed, facts, rows, compare, "left_name string, right_name string, similarity double")
