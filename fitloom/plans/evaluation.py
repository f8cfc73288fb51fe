"""Comparison of predictors on labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.functions.items import match_key
from fitloom.functions.vectors import HashingEncoder
from fitloom.operators import evaluate, lexical
from fitloom.plans.materialize import cut


def compare_predictors(pairs: DataFrame, encoders: dict | None = None) -> DataFrame:
    """One report line per predictor over prepared pairs."""
    encoders = {"encoder": HashingEncoder} if encoders is None else encoders
    runs = {name: lexical.embed_cosine(pairs, e) for name, e in encoders.items()}
    runs["tfidf"] = lexical.tfidf_cosine(pairs)
    runs["bm25"] = lexical.bm25(pairs)
    stacked = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("method"), "pred", "label")
        stacked = part if stacked is None else stacked.unionByName(part)
    return evaluate.method_report(cut(stacked))


def validation_report(pairs: DataFrame, ratio: float = 0.1, seed: int = 42, encoders: dict | None = None) -> DataFrame:
    """G1, G2, G8-G11 as one plan: prepared pairs are split by score bucket, and the predictors are compared on the
    validation rows alone; word statistics come from these rows too."""
    split = evaluate.stratified_split(pairs, ratio=ratio, seed=seed)
    return compare_predictors(cut(split.filter("is_val").select(*pairs.columns)), encoders)


def blend_inputs(pairs: DataFrame, make_encoder=HashingEncoder, patterns=None,
                 stop_items=None, item_key=match_key) -> DataFrame:
    """Label, semantic score and item overlap of every pair, the input of the weight sweep: one
    projection, so repeated ids stay as many rows as they are. ``item_key`` says which items are the same."""
    semantic = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lexical.encoded_cosine(make_encoder)))
    overlap = evaluate.item_overlap(F.col("sentence1"), F.col("sentence2"), patterns, stop_items, item_key)
    return cut(pairs.select("pair_id", "label", semantic.alias("semantic"), overlap.alias("overlap")))
