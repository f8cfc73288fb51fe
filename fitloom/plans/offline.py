"""Offline build: postings -> stored profiles; results that several steps read are stored on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.vectors import HashingEncoder, embed, group_text
from fitloom.operators import extract, hierarchy, profile, variants
from fitloom.plans.materialize import cut
from fitloom.sources import store
from fitloom.sources.taxonomy import positions


def names(weighted):
    return F.transform(weighted, lambda s: s["item"])


def profile_parts(records: DataFrame) -> dict[str, DataFrame]:
    """Extracted records -> sizes, weights, segments (long form).

    Records are stored once, so that the texts are not cleaned for each of the three; so are the
    supported items, which every later statistic reads.
    """
    records = cut(profile.known_groups(records))
    sizes = cut(profile.group_sizes(records))
    support = profile.item_support(profile.item_rows_from_lists(records))
    kept = cut(profile.minimum_support(support, sizes))
    weights = profile.item_weights(profile.scored_items(profile.item_frequency(kept), sizes))
    return {"sizes": sizes, "weights": weights, "segments": profile.group_segments(records)}


def profile_vector(make_encoder=HashingEncoder) -> Column:
    """Vector of a profile's text; its own columns are enough, so no join is needed."""
    return embed(group_text(F.col("occupation"), names(F.col("core_skills")), names(F.col("optional_skills")), F.col("responsibilities")),
                 make_encoder)


def embed_profiles(enriched: DataFrame, make_encoder=HashingEncoder) -> DataFrame:
    return enriched.select("occ_key", profile_vector(make_encoder).alias("embedding"))


def build_profiles(postings: DataFrame, make_encoder=HashingEncoder, merge_variants: bool = False,
                   patterns=None, stop_items=None, alias_rules=None,
                   model_source: str = "hashing", segment_limit: int | None = None) -> DataFrame:
    """Valid postings -> profile records ready for ``store.write_profiles``.

    A record holds all segments of its group, or the first ``segment_limit``; set one where a group may have
    more than a row should hold, and keep `operators.profile.group_segments` as a long table beside it.
    """
    cleaned = extract.clean_postings(postings, alias_rules)
    records = extract.extract_all(cleaned, patterns, stop_items)
    parts = profile_parts(records)
    weights = parts["weights"].select("occ_key", "item", "weight", "tier")
    if merge_variants:
        weights = variants.clean_weighted_profiles(weights)
    enriched = profile.enrich(weights, parts["sizes"], parts["segments"], segment_limit=segment_limit)
    return store.profile_records(cut(enriched.withColumn("embedding", profile_vector(make_encoder))), model_source=model_source)


def reembed(records: DataFrame, make_encoder=HashingEncoder) -> DataFrame:
    """Fresh vectors for stored records, everything else untouched."""
    return records.withColumn("embedding", profile_vector(make_encoder))


def build_sub_profiles(postings: DataFrame, taxonomy, parents: DataFrame, make_encoder=HashingEncoder, patterns=None,
                       stop_items=None, alias_rules=None, model_source: str = "hashing") -> DataFrame:
    """Profile records of all positions of all fields, with parent columns.

    ``parents``: (field, parent_key, parent_display) of the fields that have a profile of their own.
    """
    spark = postings.sparkSession
    records = hierarchy.sub_records(postings, taxonomy, patterns, stop_items, alias_rules)
    enriched = hierarchy.sub_enriched(records, positions(spark, taxonomy), parents)
    return store.profile_records(cut(enriched.withColumn("embedding", profile_vector(make_encoder))), model_source=model_source)


def cleaned_records(records: DataFrame, preferred=None) -> tuple[DataFrame, DataFrame]:
    """Stored records with merged spellings and new counts, and (occ_key, core_before, opt_before,
    core_after, opt_after). Vectors stay; `reembed` makes them fresh."""
    def tier(column, name):
        return records.select(F.col("key").alias("occ_key"), F.explode(column).alias("s")).select(
            "occ_key", "s.item", "s.weight", F.lit(name).alias("tier"))

    before = cut(tier("core_skills", "core").union(tier("optional_skills", "optional")))
    after = cut(variants.clean_weighted_profiles(before, preferred))
    lists = profile.nest_weights(after).withColumnRenamed("occ_key", "key")
    empty = F.array().cast(store.WEIGHTED)
    rest = [c for c in records.columns if c not in ("core_skills", "optional_skills")]
    clean = records.select(*rest).join(lists, "key", "left").withColumns({
        c: F.coalesce(c, empty) for c in ("core_skills", "optional_skills")})
    meta = F.col("meta").withField("core_skill_count", F.size("core_skills")).withField(
        "optional_skill_count", F.size("optional_skills")).withField("cleaned", F.lit(True))
    return clean.withColumn("meta", meta).select(*records.columns), variants.cleaning_stats(before, after)


def clean_store(spark, path: str, snapshot_path: str, dry_run: bool = False, preferred=None) -> DataFrame:
    """Clean a store in place after a first snapshot of it; returns the counts before and after.

    A dry run only counts.
    """
    records = store.read_profiles(spark, path)
    clean, stats = cleaned_records(records, preferred)
    stats = cut(stats)
    if not dry_run:
        store.snapshot(records, snapshot_path)
        store.write_profiles(clean, path)
    return stats
