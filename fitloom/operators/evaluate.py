"""Evaluation of predicted scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions import text as X
from fitloom.functions.arrays import keep_rows, let, range_part
from fitloom.functions.items import match_key
from fitloom.functions.numbers import minmax, round_half_even, score_bucket
from fitloom.operators.extract import extract_items
from fitloom.plans.materialize import cut

RANK_PARTS = 1024
HASH_DIGITS = 3


# --- data ----------------------------------------------------------------------------------

def scored_pairs(pairs: DataFrame) -> DataFrame:
    """A2 and the label of G1."""
    return (pairs.dropna(subset=["resume_text", "job_text", "ai_match_score"])
            .filter(F.col("ai_match_score").between(0, 100))
            .withColumn("label", F.col("ai_match_score") / 100))


def labelled_pairs(pairs: DataFrame, clean: bool = True, alias_rules=None,
                   resume_chars: int | None = None, job_chars: int | None = None) -> DataFrame:
    """G1: (pair_id, sentence1, sentence2, label). Texts are whole unless a limit is given, which is
    then the model's input size."""
    def prepared(name, limit):
        c = X.clean_text(F.col(name), alias_rules) if clean else F.col(name)
        return X.truncate(c, limit) if limit else c

    rows = scored_pairs(pairs)
    # cheap necessary conditions reach the scan
    rows = rows.filter(~X.is_blank(F.col("resume_text")) & ~X.is_blank(F.col("job_text")))
    # texts are well compressed, so one input split may hold most of them: they are dealt out before they are cleaned
    rows = rows.select("pair_id", "label", "resume_text", "job_text").repartition("pair_id", "resume_text")
    return keep_rows(rows, {
        "sentence1": prepared("resume_text", resume_chars), "sentence2": prepared("job_text", job_chars)},
        lambda made: ~X.is_blank(made["sentence1"]) & ~X.is_blank(made["sentence2"])
    ).select("pair_id", "sentence1", "sentence2", "label")


def stratified_split(df: DataFrame, key: str = "pair_id", ratio: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_val``: from every score bucket the ``round(ratio * n)`` rows with the lowest
    hash of (key, seed).

    A bucket may hold most rows, so it is not sorted as a whole.  It is cut by hash prefix into
    even parts; counts say where the limit falls, and rows are ordered inside one part only.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumns({"bucket": score_bucket(F.col("label")), "_hash": digest}) \
             .withColumn("_part", F.substring("_hash", 1, HASH_DIGITS))
    parts = rows.groupBy("bucket", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("bucket").agg(F.sum("_n").alias("_total"))
    offsets = (parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .join(totals, "bucket")
               .select("bucket", "_part", "_before",
                       round_half_even(F.col("_total") * ratio, 0).alias("_quota")))
    w = W.partitionBy("bucket", "_part").orderBy("_hash", key)
    ranked = rows.join(offsets, ["bucket", "_part"]).withColumn("_rank", F.row_number().over(w))
    return (ranked.withColumn("is_val", F.col("_before") + F.col("_rank") <= F.col("_quota"))
            .drop("_hash", "_part", "_before", "_quota", "_rank"))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """Five bins with count and share, empty ones included."""
    counts = df.groupBy(score_bucket(F.col(label)).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(label).alias("label_sum"))
    bins = df.sparkSession.range(rules.SCORE_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    total = counts.agg(F.sum("n")).scalar()
    mean = counts.agg(F.sum("label_sum") / F.sum("n")).scalar()
    return bins.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / total * 100).alias("pct"), mean.alias("mean_label"))


# --- metrics -------------------------------------------------------------------------------

def pearson(x: str | Column, y: str | Column) -> Column:
    """0 where the correlation is undefined."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def error_columns(pred: Column, label: Column) -> dict[str, Column]:
    """G6."""
    mse = F.avg((pred - label) * (pred - label))
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(pred - label))}


def average_ranks(df: DataFrame, value: str, by=(), weight: Column | None = None, parts: int = RANK_PARTS) -> DataFrame:
    """Rank of every distinct value of ``value``, ties share their mean rank.

    ``weight`` is the number of rows that a row stands for.  No window spans the whole table.
    Distinct values are counted, cut at approximate quantiles into ``parts`` of similar size, and
    ranked inside their part on top of the part's offset.  The cut is any monotone function of the
    value, so the result is exact whatever the quantiles are.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    cuts = counts.agg(F.percentile_approx(
        value, [i / parts for i in range(1, parts)], 10000)).scalar()
    counts = counts.withColumn("_cuts", cuts)
    counts = counts.withColumn("_part", range_part(F.col(value), F.col("_cuts"), parts)).drop("_cuts")
    sizes = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part",
                         F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*by, "_part").orderBy(value)
    below = F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (counts.join(sizes, [*by, "_part"])
            .withColumn("rank", F.col("_offset") + below - (F.col("_n") - 1) / 2)
            .select(*by, value, "rank"))


def value_counts(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Rows with both values, collapsed to (by, x, y, n): equal ones meet before any shuffle."""
    return df.dropna(subset=[x, y]).groupBy(*by, x, y).agg(F.count("*").alias("n"))


def with_ranks(counts: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Adds rank_x and rank_y to `value_counts`, which should be stored: it is read three times."""
    for name, out in ((x, "rank_x"), (y, "rank_y")):
        ranks = average_ranks(counts, name, by, F.col("n"))
        counts = counts.join(ranks.withColumnRenamed("rank", out), [*by, name])
    return counts


def weighted_sums(x: str, y: str, prefix: str = "r", n: str = "n") -> list[Column]:
    """What `weighted_pearson` needs of rows that stand for ``n`` rows each.

    The spread of ranks is as large as their mean, so plain sums lose no digits.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    terms = {"n": F.lit(1.0), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    return [F.sum(F.col(n) * c).alias(f"_{prefix}_{k}") for k, c in terms.items()]


def weighted_pearson(prefix: str = "r") -> Column:
    """Correlation from `weighted_sums`; 0 where it is undefined."""
    n, x, y, xx, yy, xy = (F.col(f"_{prefix}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    spread = F.sqrt((xx - x * x / n) * (yy - y * y / n))
    return F.coalesce(F.when(spread > 1e-9 * n, F.try_divide(xy - x * y / n, spread)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Rank correlation with average ranks of the rows that have both values, per ``by`` group."""
    counts = cut(value_counts(df, x, y, by))
    return with_ranks(counts, x, y, by).groupBy(*by).agg(*weighted_sums("rank_x", "rank_y")).select(
        *by, weighted_pearson().alias("spearman"))


def bucket_report(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Errors per named label range; ranges include both ends, so an edge counts in both."""
    ranges = F.array(*[F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                       for n, lo, hi in rules.SCORE_RANGES])
    y, p = F.col(label), F.col(pred)
    inside = F.filter(ranges, lambda r: (y >= r["lo"]) & (y < r["hi"] + 1e-9))
    rows = df.select(F.explode(inside).alias("r"), y.alias("y"), p.alias("p"))
    return rows.groupBy(F.col("r.bucket").alias("bucket")).agg(
        F.count("*").alias("n"),
        round_half_even(F.avg((F.col("p") - F.col("y")) ** 2), 4).alias("mse"),
        round_half_even(F.avg("p"), 4).alias("pred_mean"),
        round_half_even(F.avg("y"), 4).alias("label_mean"))


def evaluate_predictions(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """G4-G6 of one predictor over the rows that have both values, rounded as reported."""
    counts = cut(value_counts(df, pred, label))
    ranks = with_ranks(counts, pred, label).agg(*weighted_sums("rank_x", "rank_y")).select(
        round_half_even(weighted_pearson(), 4).alias("spearman"))
    errors = error_columns(F.col(pred), F.col(label))
    plain = df.dropna(subset=[pred, label]).agg(
        round_half_even(pearson(pred, label), 4).alias("pearson"),
        round_half_even(errors["mse"], 4).alias("mse"),
        round_half_even(errors["rmse"], 4).alias("rmse"))
    # one row each
    return plain.withColumn("spearman", ranks.scalar()).select("pearson", "spearman", "mse", "rmse")


def method_report(predictions: DataFrame) -> DataFrame:
    """One line per method of (method, pred, label).

    Errors use predictions scaled to [0, 1] when any of the method's lies outside; correlations
    use them as they are.
    """
    rows = predictions.dropna(subset=["pred", "label"])
    counts = cut(value_counts(rows, "pred", "label", ("method",)))
    ranks = with_ranks(counts, "pred", "label", ("method",)).groupBy("method").agg(
        *weighted_sums("rank_x", "rank_y")).select("method", round_half_even(weighted_pearson(), 4).alias("spearman"))
    span = counts.groupBy("method").agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    outside = (F.col("lo") < 0) | (F.col("hi") > 1)
    scaled = F.when(outside, minmax(F.col("pred"), F.col("lo"), F.col("hi"), digits=None)) \
              .otherwise(F.col("pred"))
    errors = error_columns(F.col("scaled"), F.col("label"))
    plain = rows.join(span, "method").withColumn("scaled", scaled).groupBy("method").agg(
        round_half_even(pearson("pred", "label"), 4).alias("pearson"),
        round_half_even(errors["rmse"], 4).alias("rmse"),
        round_half_even(errors["mae"], 4).alias("mae"))
    return ranks.join(plain, "method").select("method", "spearman", "pearson", "rmse", "mae")


def item_overlap(resume: Column, job: Column, patterns=None, stop_items=None, key: Callable[[Column], Column] = match_key) -> Column:
    """Share of the job's items that the resume has; 0 when the job has none.

    Items with the same ``key`` are the same: by default their canonical spelling in lower case, so a line
    break inside an item or a synonym makes no difference. ``F.lower`` compares them as they stand in the texts.
    """
    have = F.transform(extract_items(resume, patterns, stop_items), lambda x: key(x))
    want = F.transform(extract_items(job, patterns, stop_items), lambda x: key(x))

    def share(have, want):
        hits = F.size(F.filter(want, lambda k: F.array_contains(have, k)))
        return F.when(F.size(want) == 0, 0.0).otherwise(hits / F.size(want))

    return let(have, lambda h: let(want, lambda w: share(h, w)))


def alpha_sweep(df: DataFrame, steps: int = 10) -> DataFrame:
    """Metrics of alpha * semantic + (1 - alpha) * overlap for alpha = 0 .. 1.

    Equal rows are counted once, and the label is ranked once for all alphas.  The best alpha by
    Spearman is flagged, the lowest one on a tie.
    """
    rows = cut(df.dropna(subset=["semantic", "overlap", "label"])
               .groupBy("semantic", "overlap", "label").agg(F.count("*").alias("n")))
    labels = average_ranks(rows, "label", (), F.col("n")).withColumnRenamed("rank", "rank_y")
    grid = F.explode(F.lit([i / steps for i in range(steps + 1)])).alias("alpha")
    combined = cut(rows.join(labels, "label").select("label", "rank_y", "n", "semantic", "overlap", grid).select(
        "alpha", "label", "rank_y", "n",
        (F.col("alpha") * F.col("semantic") + (1 - F.col("alpha")) * F.col("overlap"))
        .alias("combined")))
    ranks = average_ranks(combined, "combined", ("alpha",), F.col("n")).withColumnRenamed("rank", "rank_x")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("combined")))
    error = (clipped - F.col("label")) ** 2
    sums = combined.join(ranks, ["alpha", "combined"]).groupBy("alpha").agg(
        *weighted_sums("rank_x", "rank_y", "r"), *weighted_sums("combined", "label", "p"), F.sum(F.col("n") * error).alias("_error"))
    report = sums.select(
        "alpha", round_half_even(weighted_pearson("r"), 4).alias("spearman"), round_half_even(weighted_pearson("p"), 4).alias("pearson"),
        round_half_even(F.sqrt(F.col("_error") / F.col("_r_n")), 4).alias("rmse"))
    first = W.orderBy(F.desc("spearman"), "alpha")  # one row per alpha
    return report.withColumn("is_best", F.row_number().over(first) == 1)


def threshold_separation(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Can one threshold separate positives from negatives?"""
    rows = df.select(F.col(score).alias("s"), positive.alias("p"))
    edges = rows.agg(F.min(F.when(F.col("p"), F.col("s"))).alias("min_positive"),
                     F.max(F.when(~F.col("p"), F.col("s"))).alias("max_negative"))
    lowest = rows.agg(F.min(F.when(F.col("p"), F.col("s")))).scalar()
    overlap = rows.agg(F.count_if(~F.col("p") & (F.col("s") >= lowest))).scalar()
    free = F.col("max_negative") < F.col("min_positive")
    return edges.withColumns({
        "n_overlap": overlap,
        "threshold": F.when(free, (F.col("max_negative") + F.col("min_positive")) / 2)})
