"""Group profiles (D1-D18, D27) in long form: one row per (group, item).

Statistics over the rows of a group are aggregates joined back on the group key: partial
aggregation happens before each shuffle, so a group that holds a third of all rows costs one row
per map task and item.  Windows see the supported items of a group, whose number has a bound, rank
for a top-k, where Spark keeps only k rows per group before the shuffle, or rank inside one range of
rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.arrays import ordered_distinct, range_part
from fitloom.functions.numbers import minmax, round_half_even
from fitloom.functions.text import group_key, strip
from fitloom.operators.extract import segment_key
from fitloom.plans.materialize import cut

# Ranges of rows in which the segments of a group are ranked.
SEGMENT_PARTS = 64
# Segments of a group that are listed together before its whole list is made.
BLOCK_SEGMENTS = 4096


def known_groups(df: DataFrame, label: str = "occupation") -> DataFrame:
    """Rows whose group is known, with the group key as ``occ_key``."""
    keep = F.col(label).isNotNull() & ~F.col(label).isin("", "unknown")
    return df.filter(keep).withColumn("occ_key", group_key(F.col(label)))


def _valid(item: Column) -> Column:
    return F.length(strip(item)) >= 2


# --- counting ------------------------------------------------------------------------------

def item_rows_from_lists(records: DataFrame, keys=("occ_key",)) -> DataFrame:
    """Records with item arrays -> one row per (row, distinct item), without a shuffle."""
    items = F.transform(F.filter("skills", _valid), strip)
    first = ordered_distinct(items, lambda x: F.lower(x))
    return (
        records.select(*keys, "row_id", F.posexplode(first).alias("pos", "item"))
        .select(*keys, "item", F.struct("row_id", "pos").alias("seen"))
    )


def item_rows_from_long(rows: DataFrame, order=("pos",), keys=("occ_key",)) -> DataFrame:
    """Long rows (row_id, item, order columns) -> one row per (row, distinct item).

    A row seldom repeats an item, so combining before the shuffle would only sort all rows of an input split in
    memory; they are dealt out first and sorted in the parts of the shuffle. The text in lower case is made again
    there, so each text moves once.
    """
    low = F.lower("first.item")
    seen = F.struct(F.struct(*order).alias("seen"), strip(F.col("item")).alias("item"))
    dealt = rows.filter(_valid(F.col("item"))).select("row_id", *keys, seen.alias("first")).repartition("row_id", low, *keys)
    # the row comes first: its number makes the sort of this aggregation cheap
    return dealt.groupBy("row_id", low.alias("low"), *keys).agg(F.min("first").alias("first")).select(
        *keys, "first.item", F.struct("row_id", "first.seen").alias("seen"))


def item_support(item_rows: DataFrame, keys=("occ_key",), fold_case: bool = False,
                 first_seen: bool = False) -> DataFrame:
    """Number of rows of the group that hold the item.

    Spellings are counted apart unless ``fold_case``; then the earliest spelling is shown.
    """
    aggs = [F.count("*").alias("count")]
    if first_seen or fold_case:
        aggs.append(F.min("seen").alias("first_seen"))
    if not fold_case:
        return item_rows.groupBy(*keys, "item").agg(*aggs)
    folded = item_rows.groupBy(*keys, F.lower("item").alias("low")).agg(
        *aggs, F.min_by("item", "seen").alias("item"))
    return folded.select(*keys, "item", "count", *(["first_seen"] if first_seen else []))


def group_sizes(rows: DataFrame, label: str = "occupation", keys=("occ_key",),
                distinct_rows: bool = False) -> DataFrame:
    """D3: number of rows of each group and its last seen label."""
    size = F.count_distinct("row_id") if distinct_rows else F.count("*")
    by_label = rows.groupBy(*keys, label).agg(size.alias("n"), F.max("row_id").alias("last"))
    return by_label.groupBy(*keys).agg(
        F.sum("n").alias("jd_count"), F.max_by(label, "last").alias("occupation"))


def minimum_support(support: DataFrame, sizes: DataFrame, keys=("occ_key",)) -> DataFrame:
    """Items held by at least max(2, 1 % of the group's rows)."""
    floor = F.greatest(F.lit(rules.MIN_SUPPORT_ROWS),
                       (F.col("jd_count") * rules.MIN_SUPPORT_SHARE).cast("long"))
    sizes = sizes.select(*keys, "jd_count")
    return support.join(sizes, list(keys)).filter(F.col("count") >= floor)


# --- frequency and specificity -------------------------------------------------------------

def item_frequency(kept: DataFrame) -> DataFrame:
    """Share of the group's rows that hold the item."""
    return kept.filter("jd_count > 0").withColumn(
        "frequency", round_half_even(F.col("count") / F.col("jd_count"), 6))


def document_frequency(kept: DataFrame, keys=("occ_key",)) -> DataFrame:
    """Number of groups that hold the item in any spelling.

    The last key names the group, the ones before it the corpus.
    """
    *corpus, group = keys
    return kept.groupBy(*corpus, F.lower("item").alias("low")).agg(
        F.count_distinct(group).alias("df"))


def first_spelling(kept: DataFrame) -> DataFrame:
    """First spelling per lower key: groups in key order, then by count and first sight."""
    order = F.struct("occ_key", -F.col("count"), "first_seen")
    return kept.groupBy(F.lower("item").alias("low")).agg(F.min_by("item", order).alias("spelling"))


def _corpus_size(sizes: DataFrame, corpus) -> DataFrame:
    return sizes.groupBy(*corpus).agg(F.count("*").alias("n_groups"))


def raw_tfidf(freq: DataFrame, sizes: DataFrame, keys=("occ_key",)) -> DataFrame:
    """Frequency times ln(1 + N / (1 + df)); N also counts groups without a surviving item."""
    *corpus, _group = keys
    df = document_frequency(freq, keys)
    out = freq.withColumn("low", F.lower("item")).join(df, [*corpus, "low"])
    if corpus:
        out = out.join(_corpus_size(sizes, corpus), corpus)
        n = F.col("n_groups")
    else:
        n = sizes.agg(F.count("*")).scalar()
    out = out.withColumn("raw", F.col("frequency") * F.log(1 + n / (1 + F.col("df"))))
    return out.drop("n_groups", "low")


def scored_items(freq: DataFrame, sizes: DataFrame, keys=("occ_key",)) -> DataFrame:
    """D12 and the scaled frequency in one pass: adds ``tfidf`` and ``freq_norm``.

    The window is over the supported items of a group, not over its rows: a row holds k items on
    average, each kept item is in 1 % of the rows, so there are at most about 200 k of them
    however large the group is.
    """
    w = W.partitionBy(*keys)
    return (
        raw_tfidf(freq, sizes, keys)
        .withColumns({"r0": F.min("raw").over(w), "r1": F.max("raw").over(w),
                      "f0": F.min("frequency").over(w), "f1": F.max("frequency").over(w)})
        .withColumn("tfidf", minmax(F.col("raw"), F.col("r0"), F.col("r1")))
        .withColumn("freq_norm", minmax(F.col("frequency"), F.col("f0"), F.col("f1")))
        .drop("r0", "r1", "f0", "f1")
    )


def blend(freq_norm: Column, tfidf: Column, alpha: float = rules.FREQUENCY_WEIGHT,
          beta: float = rules.SPECIFICITY_WEIGHT) -> Column:
    return round_half_even(F.lit(alpha) * freq_norm + F.lit(beta) * tfidf, 4)


def tier_of(weight: Column, threshold: float = rules.CORE_WEIGHT) -> Column:
    return F.when(weight >= threshold, "core").otherwise("optional")


def item_weights(scored: DataFrame, alpha=rules.FREQUENCY_WEIGHT, beta=rules.SPECIFICITY_WEIGHT,
                 threshold=rules.CORE_WEIGHT) -> DataFrame:
    """D16 when both scores sit in one table."""
    out = scored.withColumn("weight", blend(F.col("freq_norm"), F.col("tfidf"), alpha, beta))
    return out.withColumn("tier", tier_of(F.col("weight"), threshold))


def combine_weights(freq: DataFrame, tfidf: DataFrame, alpha=rules.FREQUENCY_WEIGHT,
                    beta=rules.SPECIFICITY_WEIGHT, threshold=rules.CORE_WEIGHT) -> DataFrame:
    """D16 on the union of two separately stored tables; a missing score counts as 0.

    ``freq`` holds (occ_key, item, freq_norm), ``tfidf`` (occ_key, item, tfidf).
    """
    both = freq.join(tfidf, ["occ_key", "item"], "full_outer").na.fill(0.0, ["freq_norm", "tfidf"])
    return item_weights(both, alpha, beta, threshold)


# --- ranked and nested views ---------------------------------------------------------------

def top_items(df: DataFrame, score: str, n: int = 20, keys=("occ_key",)) -> DataFrame:
    """The n best items of every group, ties by name."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), "item")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def compare_rankings(scored: DataFrame, n: int = 20) -> DataFrame:
    """Union of the two top-n lists side by side, 0 where an item is in one list only."""
    freq = top_items(scored, "frequency", n).select("occ_key", "item", "frequency")
    spec = top_items(scored, "tfidf", n).select("occ_key", "item", "tfidf")
    return freq.join(spec, ["occ_key", "item"], "full_outer").na.fill(0.0, ["frequency", "tfidf"])


def frequency_stats(freq: DataFrame) -> DataFrame:
    """Number of items and frequency range of every group."""
    return freq.groupBy("occ_key").agg(
        F.count("*").alias("skill_count"),
        round_half_even(F.max("frequency"), 4).alias("max_frequency"),
        round_half_even(F.min("frequency"), 4).alias("min_frequency"),
        round_half_even(F.avg("frequency"), 4).alias("mean_frequency"))


def item_across_groups(scored: DataFrame, item: str | None = None) -> DataFrame:
    """Score of an item in every group (all items when none is named), best first.

    A group that knows several spellings shows the one it lists first (count, then first sight
    where that is known, then name).
    """
    low = F.lower("item").alias("low")
    rows = scored if item is None else scored.filter(F.lower("item") == item.lower())
    seen = ["first_seen"] if "first_seen" in scored.columns else []
    order = F.struct(-F.col("count"), *seen, "item")
    return (rows.groupBy(low, "occ_key").agg(F.min_by("tfidf", order).alias("tfidf"))
            .orderBy("low", F.desc("tfidf"), "occ_key"))


def item_spread(across: DataFrame) -> DataFrame:
    """Best and weakest group of every item and the distance between them."""
    return across.groupBy("low").agg(
        F.min_by("occ_key", F.struct(-F.col("tfidf"), "occ_key")).alias("top_group"),
        F.max("tfidf").alias("top_score"),
        F.max_by("occ_key", F.struct(-F.col("tfidf"), "occ_key")).alias("bottom_group"),
        F.min("tfidf").alias("bottom_score"),
        (F.max("tfidf") - F.min("tfidf")).alias("spread"))


def first_segments(records: DataFrame, keys=("occ_key",), key_chars: int | None = None) -> DataFrame:
    """(keys, row_id, pos, seg) of the distinct segments of a group where they are first seen.

    Repeats meet by digest before the shuffle, so each text moves once per task.
    """
    seg = (
        records.select(*keys, "row_id", F.posexplode("responsibilities").alias("pos", "seg"))
        .filter(F.length("seg") >= rules.MIN_GROUP_SEGMENT_CHARS)
        .withColumn("seg", strip(F.col("seg")))
        .withColumn("digest", F.sha2(segment_key(F.col("seg"), key_chars), 256))
    )
    return (
        seg.groupBy("digest", *keys)  # the selective column first: it decides the sort
        .agg(F.min(F.struct("row_id", "pos", "seg")).alias("first"))
        .select(*keys, "first.*")
    )


def row_ranges(rows: DataFrame, parts: int = SEGMENT_PARTS) -> DataFrame:
    """``rows`` with ``_part``: the range of row_id that a row lies in, ranges of similar numbers of rows.

    All groups are cut at the same places, so a group with most of the rows is in most of the parts.
    """
    cuts = rows.agg(F.percentile_approx("row_id", [i / parts for i in range(1, parts)], 10000)).scalar()
    return rows.withColumn("_cuts", cuts).withColumn("_part", range_part(F.col("row_id"), F.col("_cuts"), parts)).drop("_cuts")


def group_segments(records: DataFrame, keys=("occ_key",), limit: int | None = None,
                   key_chars: int | None = None, parts: int = SEGMENT_PARTS) -> DataFrame:
    """(keys, row_id, pos, seg, rank): distinct segments of a group, ranked in order of first sight, the
    first ``limit`` of them if given. This long table has all of them whatever a profile's record shows.

    No task ranks a whole group: segments are cut into ranges of row_id (numbers), counted per group
    and range, and ranked inside their range on top of what the ranges before it hold.
    """
    first = row_ranges(cut(first_segments(records, keys, key_chars)), parts)
    counts = first.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if limit is not None:
        offsets = offsets.filter(F.col("_offset") < limit)
    inside = W.partitionBy(*keys, "_part").orderBy("row_id", "pos")
    ranked = first.join(offsets, [*keys, "_part"]).withColumn("rank", F.col("_offset") + F.row_number().over(inside))
    ranked = ranked.drop("_part", "_offset")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def segment_blocks(segs: DataFrame, keys=("occ_key",), limit: int | None = None) -> DataFrame:
    """(keys, block): the segments of a group, or the first ``limit``, in lists of `BLOCK_SEGMENTS` ranks each.

    A group can hold most of the text, so its list is put together from a few lists, not from an object per segment.
    """
    kept = segs if limit is None else segs.filter(F.col("rank") <= limit)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "seg")))
    place = F.floor(F.col("rank") / BLOCK_SEGMENTS).alias("place")
    return kept.groupBy(*keys, place).agg(F.transform(ordered, lambda s: s["seg"]).alias("segs")).select(
        *keys, F.struct("place", "segs").alias("block"))


def _joined_blocks() -> Column:
    return F.flatten(F.transform(F.sort_array(F.collect_list("block")), lambda b: b["segs"]))


def nest_segments(segs: DataFrame, keys=("occ_key",), limit: int | None = None) -> DataFrame:
    """The segments of a group as one list, the first ``limit`` of them if given: a limit bounds the record of a
    group that holds a large share of all postings."""
    return segment_blocks(segs, keys, limit).groupBy(*keys).agg(_joined_blocks().alias("responsibilities"))


def assemble_profiles(kept: DataFrame, sizes: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """One row per group with its items by count (ties by first sight).

    The list is bounded like the window of ``scored_items``: by the minimum support of 1 %.
    """
    entry = F.struct(-F.col("count"), "first_seen", "item", "count")
    nested = kept.groupBy("occ_key").agg(F.sort_array(F.collect_list(entry)).alias("e")).select(
        "occ_key",
        F.transform("e", lambda s: s["item"]).alias("skills"),
        F.transform("e", lambda s: F.struct(s["item"].alias("item"), s["count"].alias("count")))
        .alias("skill_counts"))
    out = sizes.join(nested, "occ_key", "left")
    if segs is not None:
        out = out.join(nest_segments(segs), "occ_key", "left")
    else:
        out = out.withColumn("responsibilities", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return out.withColumns({
        "skills": F.coalesce("skills", none),
        "skill_counts": F.coalesce("skill_counts",
                                   F.array().cast("array<struct<item:string,count:bigint>>")),
        "responsibilities": F.coalesce("responsibilities", none)})


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Sizes and the five most frequent items of every group, largest group first."""
    return profiles.select(
        "occ_key", "occupation", "jd_count",
        F.size("skills").alias("unique_skills"),
        F.size("responsibilities").alias("responsibility_count"),
        F.array_join(F.slice("skills", 1, 5), ", ").alias("top_5_skills"),
    ).orderBy(F.desc("jd_count"), "occ_key")


def nest_weights(weights: DataFrame, keys=("occ_key",)) -> DataFrame:
    """Core and optional items of a group, heaviest first."""
    def ranked(tier):
        entry = F.when(F.col("tier") == tier, F.struct(-F.col("weight"), "item", "weight"))
        return F.transform(F.sort_array(F.collect_list(entry)),
                           lambda s: F.struct(s["item"].alias("item"), s["weight"].alias("weight")))
    return weights.groupBy(*keys).agg(
        ranked("core").alias("core_skills"), ranked("optional").alias("optional_skills"))


def enrich(weights: DataFrame, sizes: DataFrame, segs: DataFrame, keys=("occ_key",), segment_limit: int | None = None) -> DataFrame:
    """Group, core, optional, segments (the first ``segment_limit`` if given), size.

    The other columns travel to the segments as one more row of the group: a join would sort and copy rows that
    hold all segments of a group.
    """
    empty = F.array().cast("array<struct<item:string,weight:double>>")
    rest = [c for c in sizes.columns if c not in keys]
    heads = sizes.join(nest_weights(weights, keys), list(keys), "left").select(
        *keys, F.struct(*rest, F.coalesce("core_skills", empty).alias("core_skills"),
                        F.coalesce("optional_skills", empty).alias("optional_skills")).alias("head"))
    both = heads.unionByName(segment_blocks(segs, keys, segment_limit), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.first("head", ignorenulls=True).alias("head"), _joined_blocks().alias("responsibilities")).filter(
        "head is not null").select(*keys, "head.*", "responsibilities")
