"""Two-level groups (D23, D24), summaries of the store and of the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.items import assign_position
from fitloom.functions.text import display_name
from fitloom.operators import extract, profile, variants
from fitloom.plans.materialize import cut

SUB = ("parent", "occ_key")


def assign_postings(postings: DataFrame, taxonomy) -> DataFrame:
    """B17 on a table: adds ``parent`` and ``sub``; titles without a rule get a null ``sub``."""
    return postings.withColumn("parent", F.col("category")).withColumn(
        "sub", assign_position(F.col("job_title"), F.col("category"), taxonomy))


def sub_coverage(assigned: DataFrame, positions: DataFrame) -> DataFrame:
    """Postings per position, positions without any included.

    ``positions`` is the rule table (parent, sub, display).
    """
    counts = assigned.groupBy("parent", "sub").agg(F.count("*").alias("n_rows"))
    return positions.join(counts, ["parent", "sub"], "left").na.fill(0, ["n_rows"])


def sub_records(postings: DataFrame, taxonomy, patterns=None, stop_items=None, alias_rules=None) -> DataFrame:
    """Extracted postings that have a position, with their field as ``parent``."""
    cleaned = extract.clean_postings(assign_postings(postings, taxonomy).filter("sub IS NOT NULL"),
                                     alias_rules)
    records = extract.extract_all(cleaned.withColumn("category", F.col("sub")), patterns,
                                  stop_items, extra=("parent",))
    return cut(profile.known_groups(records))


def sub_profiles(postings: DataFrame, taxonomy, patterns=None, stop_items=None,
                 alias_rules=None) -> DataFrame:
    """Weights of every position; the corpus of a position is its own field.

    All fields run in one plan: the field is part of every key, so N and df are per field.
    """
    records = sub_records(postings, taxonomy, patterns, stop_items, alias_rules)
    return sub_weights(records)


def sub_weights(records: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Cleaned weights of every position; ``sizes`` are the stored group sizes, if the caller has them."""
    sizes = cut(profile.group_sizes(records, keys=SUB)) if sizes is None else sizes
    support = profile.item_support(profile.item_rows_from_lists(records, SUB), SUB)
    kept = cut(profile.minimum_support(support, sizes, SUB))
    scored = profile.scored_items(profile.item_frequency(kept), sizes, SUB)
    weights = profile.item_weights(scored).select(*SUB, "item", "weight", "tier")
    return variants.clean_weighted_profiles(weights, keys=SUB)


def sub_enriched(records: DataFrame, positions: DataFrame, parents: DataFrame) -> DataFrame:
    """Whole profiles of all positions with their field: key, both tiers, segments, size, parent.

    ``positions``: (parent, sub, display); ``parents``: (field, parent_key, parent_display), where
    fields without an entry are their own parent.
    """
    sizes = cut(profile.group_sizes(records, keys=SUB))
    rows = profile.enrich(sub_weights(records, sizes), sizes.drop("occupation"), profile.group_segments(records, SUB), SUB)
    shown = positions.select("parent", F.col("sub").alias("occ_key"), F.col("display").alias("sub_display"))
    fields = parents.select(F.col("field").alias("parent"), "parent_key", "parent_display")
    root = F.coalesce("parent_key", "parent")
    return rows.join(shown, list(SUB), "left").join(fields, "parent", "left").select(
        F.concat(root, F.lit("__"), "occ_key").alias("occ_key"), F.concat("parent", F.lit(" / "), "occ_key").alias("occupation"),
        "core_skills", "optional_skills", "responsibilities", "jd_count", root.alias("parent"),
        F.coalesce("parent_display", display_name(F.col("parent"))).alias("parent_display"),
        F.col("occ_key").alias("sub_occupation"), F.coalesce("sub_display", "occ_key").alias("sub_display"))


def catalogue_entries(records: DataFrame) -> DataFrame:
    """Input of `catalogue` from stored records of both levels."""
    return records.select("key", "occupation", F.size("core_skills").cast("long").alias("core_skill_count"),
                          "parent", "parent_display", "sub_display")


def catalogue(entries: DataFrame) -> DataFrame:
    """Every group with its field: roots are their own parent.

    ``entries``: key, occupation, core_skill_count, and nullable parent, parent_display,
    sub_display.
    """
    is_sub = F.coalesce("parent", F.lit("")) != ""
    shown = F.nullif(F.col("parent_display"), F.lit(""))
    sub_shown = F.nullif(F.col("sub_display"), F.lit(""))
    display = display_name(F.col("occupation"))
    return entries.select(
        "key", display.alias("display"), "core_skill_count",
        F.when(is_sub, F.col("parent")).otherwise(F.col("key")).alias("parent_key"),
        F.when(is_sub, F.coalesce(shown, display_name(F.col("parent"))))
        .otherwise(display).alias("parent_display"),
        F.when(is_sub, F.coalesce(sub_shown, display)).alias("sub_display"),
        is_sub.alias("is_sub"))


def resolve_parent(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Key of the root whose label is the field's name; the name itself when there is none."""
    roots = (entries.filter(F.coalesce("parent", F.lit("")) == "")
             .groupBy(F.col("occupation").alias("field")).agg(F.min("key").alias("root_key")))
    return fields.join(roots, "field", "left").select(
        "field", F.coalesce("root_key", "field").alias("parent_key"))


def positions_by_parent(items: DataFrame) -> DataFrame:
    """Entries of every field's menu: first the general one, then its positions by name."""
    subs = items.filter("is_sub").select(
        "parent_key", F.coalesce("sub_display", "display").alias("label"), "key", "display")
    w = W.partitionBy("parent_key").orderBy("display", "key")
    subs = subs.withColumn("position", F.row_number().over(w)).drop("display")
    heads = items.select("parent_key").distinct().select(
        "parent_key", F.lit(rules.GENERAL_ENTRY).alias("label"),
        F.col("parent_key").alias("key"), F.lit(0).alias("position"))
    return heads.unionByName(subs)


def store_summary(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """Items per tier and rows of every group, plus the grand total (null key)."""
    tiers = weights.groupBy("occ_key").agg(
        F.count_if(F.col("tier") == "core").alias("n_core"),
        F.count_if(F.col("tier") == "optional").alias("n_optional"))
    per_group = sizes.select("occ_key", "jd_count").join(tiers, "occ_key", "left").na.fill(0)
    total = F.sum("n_core") + F.sum("n_optional")
    return per_group.rollup("occ_key").agg(
        F.sum("n_core").alias("n_core"), F.sum("n_optional").alias("n_optional"),
        F.sum("jd_count").alias("jd_count"),
        (F.sum("n_core") / F.greatest(total, F.lit(1))).alias("core_share"))


def postings_profile(postings: DataFrame, top: int = 10) -> DataFrame:
    """Rows, number of groups and the largest groups, as (metric, key, value)."""
    counts = postings.groupBy("category").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("category").alias("groups"))
    long = totals.selectExpr(
        "stack(2, 'rows', '', cast(rows as double), 'groups', '', cast(groups as double)) "
        "AS (metric, key, value)")
    largest = (counts.filter("category IS NOT NULL").orderBy(F.desc("n"), "category").limit(top)
               .select(F.lit("group_rows").alias("metric"), F.col("category").alias("key"),
                       F.col("n").cast("double").alias("value")))
    return long.unionByName(largest)


def pairs_profile(pairs: DataFrame) -> DataFrame:
    """Rows and score range of the pair table."""
    return pairs.agg(
        F.count("*").alias("rows"), F.min("ai_match_score").alias("score_min"),
        F.max("ai_match_score").alias("score_max"), F.avg("ai_match_score").alias("score_mean"))


def extraction_profile(records: DataFrame) -> DataFrame:
    """Items per row and share of rows without any."""
    n = F.size("skills")
    return records.agg(
        F.count("*").alias("rows"), F.min(n).alias("items_min"), F.max(n).alias("items_max"),
        F.avg(n).alias("items_mean"), F.avg((n == 0).cast("double")).alias("share_empty"),
        F.avg(F.size("responsibilities")).alias("segments_mean"))
