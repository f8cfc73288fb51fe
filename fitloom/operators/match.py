"""Matching documents to group profiles.

Items of documents and of profiles are rows; they meet in one join on (group, match key), so the
work and the output grow with the items and the matches, never with their product.  What a group
misses is taken from a list that is made once per group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.arrays import let
from fitloom.functions.items import canonicalize, match_key
from fitloom.functions.numbers import clamp01, round_half_even
from fitloom.functions.text import display_name, strip
from fitloom.functions.vectors import Encoder, HashingEncoder, semantic_score
from fitloom.operators.similar import similar_names
from fitloom.plans.materialize import cut

# Rank of an exact match, above those of similar names, which are millionths.
EXACT = 2_000_000
# Bits of a rank, of an item's number in its group and of a place in a document; a list is one row, so it is far shorter.
BITS = 21
WIDE = 1 << BITS
DOC = ["doc_id", "target_key"]
# Columns of documents that are part of the analysis record.
RECORD = ("user_id", "cv_filename", "skills", "experience", "projects", "education")


def profile_items(kb: DataFrame) -> DataFrame:
    """(target_key, item, weight, key, name): items of both tiers; a name in both keeps its core weight."""
    def tier(column, number):
        return kb.select(F.col("key").alias("target_key"), F.explode(column).alias("s")).select(
            "target_key", "s.item", "s.weight", F.lit(number).alias("tier"))

    items = tier("core_skills", 0).union(tier("optional_skills", 1)).groupBy("target_key", "item").agg(
        F.min_by("weight", "tier").alias("weight"))
    return items.withColumn("name", canonicalize(F.col("item"))).withColumn("key", F.lower(strip(F.col("name"))))


def candidate_items(docs: DataFrame) -> DataFrame:
    """(doc_id, target_key, key, candidate, first, name, position, spelled), one row per distinct key of a document.

    Of repeated keys the last item counts for an exact match, the first one for a similar name;
    ``spelled`` are all of them with their positions.
    """
    each = docs.select(*DOC, F.posexplode("skills").alias("position", "item"))
    each = each.withColumn("name", canonicalize(F.col("item"))).withColumn("key", F.lower(strip(F.col("name"))))
    return each.groupBy(*DOC, "key").agg(
        F.max_by("item", "position").alias("candidate"), F.min_by("item", "position").alias("first"),
        F.min_by("name", "position").alias("name"), F.min("position").alias("position"),
        F.collect_list(F.struct("position", "item")).alias("spelled"))


def exact_rows(docs: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """(doc_id, target_key, key, position, candidate, item, weight): every candidate item next to the group items with its
    key; ``how`` as in a join. A document without items has one row without candidate, for an outer join."""
    each = docs.select(*DOC, F.posexplode_outer("skills").alias("position", "candidate")).withColumn("key", match_key(F.col("candidate")))
    return each.join(items.drop("name"), ["target_key", "key"], how)


def nearest_rows(candidates: DataFrame, items: DataFrame, close: DataFrame) -> DataFrame:
    """(doc_id, target_key, item, weight, candidate, similarity, key): for each group item its exact match, else the
    closest candidate of the document.

    What a name may stand for in a group is one list of numbers. Candidates take their list along to their document,
    and the best ones are picked inside its row, so no pair of items is ever shuffled.
    """
    listed = cut(items.groupBy("target_key").agg(F.collect_list(F.struct("item", "weight", "name", "key")).alias("listed")))
    numbered = listed.select("target_key", F.posexplode("listed").alias("number", "i")).select("target_key", "number", "i.name", "i.key")
    same = candidates.select("target_key", "name", "key").distinct().join(numbered.drop("name"), ["target_key", "key"]).select(
        "target_key", "name", "number", F.lit(EXACT).alias("rank"))
    alike = numbered.join(close, F.col("name") == F.col("right_name")).select(
        "target_key", F.col("left_name").alias("name"), "number", F.round(F.col("similarity") * 1_000_000).cast("int").alias("rank"))
    # one number orders by item, then from the best rank down, then by place in the document
    entry = (F.col("number").cast("long") * WIDE + (WIDE - 1 - F.col("rank"))) * WIDE
    reach = same.unionByName(alike).groupBy("target_key", "name").agg(F.collect_list(entry).alias("reach"))
    # candidates and lists of similar names are far larger than their stored size tells: never broadcast
    met = candidates.select(*DOC, "position", "candidate", "first", "name").join(reach.hint("merge"), ["target_key", "name"]).select(
        *DOC, F.struct("position", "candidate", "first", "name", "reach").alias("c"))
    each = met.repartition(*DOC).groupBy(*DOC).agg(F.sort_array(F.collect_list("c")).alias("own"))
    entries = F.flatten(F.transform("own", lambda c, at: F.transform(c["reach"], lambda e: e + at)))
    best = let(F.sort_array(entries), lambda s: F.filter(s, lambda e, i: (i == 0) | (
        F.shiftright(e, 2 * BITS) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), 2 * BITS))))
    fits = (F.size("own") < WIDE) & (F.size("listed") < WIDE)
    rows = each.join(listed, "target_key").select(*DOC, "own", "listed", F.explode(F.when(fits, best).otherwise(
        F.raise_error(F.lit(f"a list of {WIDE} items or more")))).alias("b"))
    number, rank, at = F.shiftright("b", 2 * BITS).cast("int"), WIDE - 1 - F.shiftright("b", BITS) % WIDE, (F.col("b") % WIDE).cast("int")
    own, item, is_exact = F.get("own", at), F.get("listed", number), rank == EXACT
    return rows.filter(is_exact | F.col("doc_id").isNotNull()).select(
        *DOC, item["item"].alias("item"), item["weight"].alias("weight"), F.when(is_exact, own["candidate"]).otherwise(own["first"]).alias("candidate"),
        F.when(is_exact, 1.0).otherwise(round_half_even(rank / 1_000_000, 4)).alias("similarity"), F.lower(strip(own["name"])).alias("key"))


def match_rows(docs: DataFrame, kb: DataFrame, mode: str = "exact",
               threshold: float = rules.SEMANTIC_ITEM_THRESHOLD,
               make_encoder: Callable[[], Encoder] = HashingEncoder, keep_unmatched: bool = False) -> DataFrame:
    """(doc_id, target_key, item, weight, candidate, similarity, key), one row per matched item.

    ``docs``: doc_id (unique), target_key, skills, ...; ``kb``: key, core_skills, optional_skills, ...
    Mode "semantic" takes the closest candidate item of the document for items without an exact
    match, the first one on ties.  With ``keep_unmatched`` candidates that nothing used have a row
    without item; ``spelled`` holds their texts.
    """
    columns = [*DOC, "item", "weight", "candidate", "similarity", "key"] + ["spelled"] * keep_unmatched
    if mode != "semantic" and not keep_unmatched:
        return exact_rows(docs, profile_items(kb)).groupBy(*DOC, "item").agg(
            F.first("weight").alias("weight"), F.max_by("candidate", "position").alias("candidate"), F.lit(1.0).alias("similarity"),
            F.first("key").alias("key")).select(*columns)
    candidates, items = candidate_items(docs), profile_items(kb)
    if mode != "semantic":
        met = candidates.join(items.drop("name"), ["target_key", "key"], "left")
        return met.withColumn("similarity", F.when(F.col("item").isNotNull(), 1.0)).select(*columns)
    candidates, items = cut(candidates), cut(items)
    close = similar_names(candidates.select("name"), items.select("name"), threshold, make_encoder)
    matched = nearest_rows(candidates, items, close)
    if not keep_unmatched:
        return matched
    return candidates.select(*DOC, "key", "spelled").join(matched, [*DOC, "key"], "left").select(*columns)


def group_facts(kb: DataFrame, least: float = rules.TIER_IMPORTANT) -> DataFrame:
    """(target_key, total, wanted): weight of all items of a group, and its items of the upper tiers,
    heaviest first."""
    order = F.when(F.col("weight") >= least, F.struct((-F.col("weight")).alias("order"), "item"))
    return profile_items(kb).groupBy("target_key").agg(
        F.sum("weight").alias("total"),
        F.transform(F.sort_array(F.collect_list(order)), lambda s: s["item"]).alias("wanted"))


def weighted_coverage(matched: Column, total: Column) -> Column:
    """weight of the matched items over the weight of all; no weight gives 0."""
    return clamp01(F.when(total > 0, F.coalesce(matched, F.lit(0.0)) / total).otherwise(0.0))


def final_score(semantic: Column, weighted: Column, alpha: float = rules.SEMANTIC_WEIGHT,
                beta: float = rules.COVERAGE_WEIGHT) -> Column:
    """blended score before rounding."""
    return clamp01(F.lit(alpha) * semantic + F.lit(beta) * weighted)


def gaps(docs: DataFrame, kb: DataFrame, mode: str = "exact", **options) -> DataFrame:
    """(doc_id, target_key, weighted, matched_skills, missing_skills, extra_skills) of every document
    whose id is not null and whose group is known; lists are heaviest first, extra items in the document's order.

    Both tables are read by several branches. Items go to their document in one step, with no shuffle by item on the way.
    """
    empty = F.array().cast("array<string>")
    known = group_facts(kb).join(kb.select(F.col("key").alias("target_key")), "target_key", "right")
    docs = docs.filter("doc_id IS NOT NULL")
    if mode == "semantic":
        rows = match_rows(docs, kb, mode, keep_unmatched=True, **options)
        alone = F.flatten(F.collect_list(F.when(F.col("item").isNull(), F.col("spelled"))))
    else:
        rows = exact_rows(docs, profile_items(kb), "left")
        alone = F.collect_list(F.when(F.col("item").isNull() & F.col("position").isNotNull(), F.struct("position", F.col("candidate").alias("item"))))
    heaviest = F.when(F.col("item").isNotNull(), F.struct((-F.col("weight")).alias("order"), "item"))
    found = rows.groupBy(*DOC).agg(F.sort_array(F.collect_set(heaviest)).alias("hits"), F.sort_array(alone).alias("extra"))
    if mode == "semantic":
        found = docs.select(*DOC).join(found, DOC, "left")
    hit = F.aggregate("hits", F.lit(0.0), lambda s, h: s - h["order"])
    matched = F.coalesce(F.transform("hits", lambda h: h["item"]), empty)
    return found.join(known, "target_key").select(
        *DOC, weighted_coverage(hit, F.coalesce("total", F.lit(0.0))).alias("weighted"), matched.alias("matched_skills"),
        F.array_except(F.coalesce("wanted", empty), matched).alias("missing_skills"),
        F.coalesce(F.transform("extra", lambda s: s["item"]), empty).alias("extra_skills"))


def score_documents(docs: DataFrame, kb: DataFrame, alpha: float = rules.SEMANTIC_WEIGHT,
                    beta: float = rules.COVERAGE_WEIGHT, **options) -> DataFrame:
    """F3-F5 as one record per document: scores, gaps, the group's display and core items, and the
    columns of `RECORD` that ``docs`` has.

    Needs ``embedding`` on both sides; texts and vectors stay out of the joins on items.
    """
    shown = F.col("occupation") if "occupation" in kb.columns else F.lit(None).cast("string")
    groups = kb.select(F.col("key").alias("target_key"), F.col("embedding").alias("group_embedding"),
                       F.coalesce(shown, display_name(F.col("key"))).alias("occupation_display"),
                       F.transform("core_skills", lambda s: s["item"]).alias("core_skills"))
    record = [c for c in RECORD if c in docs.columns]
    semantic = F.coalesce(semantic_score(F.col("embedding"), F.col("group_embedding")), F.lit(0.0))
    near = docs.join(groups, "target_key").select(*DOC, *record, "occupation_display", "core_skills", semantic.alias("_semantic"))
    found = gaps(docs, kb, **options)
    return near.join(found, DOC).select(
        *DOC,
        round_half_even(F.col("_semantic"), 4).alias("semantic_similarity_score"),
        round_half_even(F.col("weighted"), 4).alias("weighted_skill_score"),
        round_half_even(final_score(F.col("_semantic"), F.col("weighted"), alpha, beta), 4).alias("match_score"),
        "matched_skills", "missing_skills", "extra_skills", "occupation_display", "core_skills", *record)
