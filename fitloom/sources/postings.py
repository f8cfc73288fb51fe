"""Input tables (A1-A3); rows that can't be used are kept aside with the reason."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fitloom.functions.text import is_blank, strip
from fitloom.plans.materialize import cut

# Holds the text of a record that doesn't fit the columns.
CORRUPT = "_corrupt_record"


class Checked(NamedTuple):
    """Rows to use; rows kept aside: (row_id, reason, record), the record being the text that was read or the
    row as JSON; how many rows were read and how many had each reason."""

    kept: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def read_csv(spark: SparkSession, path: str, row_key: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with quoted multi-line fields, all columns as text, and `CORRUPT`: the record itself where it has
    more or fewer fields than there are columns.

    The columns are those of the header, or ``columns`` for files without one. There is no inference pass.  ``row_id`` comes
    from ``row_key`` or, without one, is the row's number within this read, so equal rows have ids
    of their own.  A file of multi-line records is read by one task, in order, so a retry gives
    the same numbers; store the table to keep them for another read.
    """
    options = {"header": columns is None, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.csv(path, **options).columns if columns is None else columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, CORRUPT])
    # pruned columns would not be counted, and a short record would pass
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path, **options)
    return df.withColumn("row_id", F.col(row_key) if row_key else F.monotonically_increasing_id())


def posting_fault(df: DataFrame) -> Column:
    """A1: why a row is no posting, else null: group, title and description must be there, and description or
    requirements must have text."""
    needs = F.col("requirements_text") if "requirements_text" in df.columns else F.lit("")
    missing = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("category", "job_title", "description")))
    return F.coalesce(missing, F.when((strip(F.col("description")) == "") & is_blank(needs), F.lit("blank")))


def pair_fault(df: DataFrame) -> Column:
    """A2: why a row is no pair, else null: both texts and a score in [0, 100] must be there."""
    missing = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("resume_text", "job_text", "ai_match_score")))
    score = F.col("ai_match_score").try_cast("double")
    return F.coalesce(missing, F.when(score.isNull(), F.lit("score is no number")), F.when(~score.between(0, 100), F.lit("score out of range")))


def checked(df: DataFrame, fault: Column, row_id: str = "row_id") -> Checked:
    """Rows with and without a fault. The table is read and stored once, counted on the way."""
    broken = F.when(F.col(CORRUPT).isNotNull(), F.lit("columns")) if CORRUPT in df.columns else F.lit(None).cast("string")
    marked = df.withColumn("_reason", F.coalesce(broken, fault))
    seen = Observation()
    table = cut(marked.observe(seen, F.count(F.lit(1)).alias("read"), F.count("_reason").alias("rejected")))
    counts = dict(seen.get)
    each = {r["_reason"]: r["n"] for r in table.filter("_reason is not null").groupBy("_reason").agg(F.count("*").alias("n")).collect()}
    whole = F.to_json(F.struct(*(F.col(c) for c in df.columns if c not in (CORRUPT, row_id))))
    record = F.coalesce(F.col(CORRUPT), whole) if CORRUPT in df.columns else whole
    rejected = table.filter("_reason is not null").select(F.col(row_id), F.col("_reason").alias("reason"), record.alias("record"))
    return Checked(table.filter("_reason is null").drop("_reason", CORRUPT), rejected, counts | each)


def valid_postings(df: DataFrame) -> DataFrame:
    """A1: group, title and description are present; description or requirements has text."""
    df = df.dropna(subset=["category", "job_title", "description"])
    needs = F.col("requirements_text") if "requirements_text" in df.columns else F.lit("")
    return df.filter(~((strip(F.col("description")) == "") & is_blank(needs)))


def valid_pairs(df: DataFrame) -> DataFrame:
    """A2: both texts and a score in [0, 100] are present."""
    df = df.withColumn("ai_match_score", F.col("ai_match_score").try_cast("double"))
    df = df.dropna(subset=["resume_text", "job_text", "ai_match_score"])
    return df.filter(F.col("ai_match_score").between(0, 100))


def check_postings(spark: SparkSession, path: str, row_key: str | None = None, columns: list[str] | None = None) -> Checked:
    """A1: postings from CSV, and what is no posting kept aside."""
    df = read_csv(spark, path, row_key, columns)
    return checked(df, posting_fault(df))


def check_pairs(spark: SparkSession, path: str, row_key: str | None = None, columns: list[str] | None = None) -> Checked:
    """A2: pairs from CSV with their score as a number, and what is no pair kept aside."""
    df = read_csv(spark, path, row_key, columns).withColumnRenamed("row_id", "pair_id")
    out = checked(df, pair_fault(df), "pair_id")
    return out._replace(kept=out.kept.withColumn("ai_match_score", F.col("ai_match_score").try_cast("double")))


def load_postings(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    """A1: the postings alone; broken records are left out (`check_postings` keeps them aside)."""
    return check_postings(spark, path, row_key).kept


def load_pairs(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    """A2: the pairs alone; broken records are left out (`check_pairs` keeps them aside)."""
    return check_pairs(spark, path, row_key).kept


def load_all(spark: SparkSession, postings_path: str, pairs_path: str) -> dict[str, DataFrame]:
    """A3: the inputs by name, also as temporary views."""
    tables = {"postings": load_postings(spark, postings_path),
              "pairs": load_pairs(spark, pairs_path)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables
