"""Cleaning of postings and pairs (B10, B11) and item extraction.

Everything here is row-local: one projection over the scan; only pairs of texts are dealt out before it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions import text as X
from fitloom.functions.arrays import keep_rows, let, ordered_distinct
from fitloom.functions.items import is_stop_item

FREE_TEXT = ("description", "requirements_text")
LISTS = ("technical_skills", "soft_skills")
EMPTY = "array<string>"


def clean_postings(df: DataFrame, alias_rules=None) -> DataFrame:
    """Clean free text and lists, build ``full_text``, drop rows where it is blank."""
    free = [c for c in FREE_TEXT if c in df.columns]
    lists = [c for c in LISTS if c in df.columns]
    made = {**{c: X.clean_text(F.col(c), alias_rules) for c in free},
            **{f"{c}_parsed": X.clean_list(F.col(c), alias_rules) for c in lists}}
    # a row without any raw text has none after cleaning; this much reaches the scan
    df = df.filter(reduce(or_, [~X.is_blank(F.col(c)) for c in (*free, *lists)], F.lit(False)))
    named = F.struct(*[c.alias(n) for n, c in made.items()])

    def full(row):
        parts = [F.nullif(row[c], F.lit("")) for c in free]
        parts += [F.nullif(F.array_join(row[f"{c}_parsed"], ", "), F.lit("")) for c in lists]
        return F.struct(*[row[n].alias(n) for n in made], F.concat_ws("\n", *parts).alias("full_text"))

    rows = F.filter(F.transform(F.array(named), full), lambda row: ~X.is_blank(row["full_text"]))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in made]
    new = [n for n in (*made, "full_text") if n not in df.columns]
    return df.select(*rest, F.inline(rows)).select(*df.columns, *new)


def clean_pairs(df: DataFrame, alias_rules=None) -> DataFrame:
    """Clean both texts, keep pairs where neither is blank."""
    texts = ("resume_text", "job_text")
    df = df.filter(~X.is_blank(F.col(texts[0])) & ~X.is_blank(F.col(texts[1])))
    # texts are well compressed, so one input split may hold most of them: they are dealt out before they are cleaned
    df = df.repartition(*texts)
    return keep_rows(df, {c: X.clean_text(F.col(c), alias_rules) for c in texts},
                     lambda made: ~X.is_blank(made[texts[0]]) & ~X.is_blank(made[texts[1]]))


def extract_items(c: Column, patterns=None, stop_items=None) -> Column:
    """First match of every pattern, in dictionary order, without stop items and repeats.

    A byte search for the literal part of each pattern decides which regexes run at all.
    """
    patterns = rules.ITEM_PATTERNS if patterns is None else patterns
    table = X.rule_table(
        [{"lit": X.required_literal(p), "pat": X.java_pattern(p)} for p in patterns],
        "lit string, pat string")

    def first_match(text, rule):
        return X.strip(F.call_function("regexp_extract", text, rule["pat"], F.lit(0)))

    possible = let(X.fold(c), lambda f: F.filter(table, lambda r: F.contains(f, r["lit"])))
    found = let(c, lambda text: F.transform(possible, lambda r: first_match(text, r)))
    kept = F.filter(found, lambda x: (x != "") & ~is_stop_item(x, stop_items))
    return ordered_distinct(kept, lambda x: F.lower(x))


def merge_items(*lists: Column, stop_items=None) -> Column:
    """Lists joined by priority, without short, stop and repeated items."""
    trimmed = F.transform(F.concat(*lists), X.strip)
    kept = F.filter(trimmed, lambda x: (F.length(x) >= 2) & ~is_stop_item(x, stop_items))
    return ordered_distinct(kept, lambda x: F.lower(x))


def segments(description: Column, fallback: Column, limit: int | None = None,
             key_chars: int | None = None) -> Column:
    """C4: bullet, number and paragraph segments of the description.

    All distinct ones; ``limit`` keeps the first ones, ``key_chars`` compares only beginnings.
    """
    source = F.when(X.is_blank(description), F.coalesce(fallback, F.lit(""))).otherwise(description)
    pattern = rules.SEGMENT_SPLIT.replace(r"\s", X.WS).replace(r"\d", r"\p{Nd}")
    header = "(?iU)^(?:" + "|".join(rules.SEGMENT_HEADERS) + rf")(?:{X.WS}|:)*$"
    parts = F.transform(F.split(source, pattern), X.strip)
    kept = F.filter(parts, lambda s: (F.length(s) >= rules.MIN_SEGMENT_CHARS)
                    & ~F.regexp_like(s, F.lit(header)))
    return ordered_distinct(kept, lambda s: segment_key(s, key_chars), limit)


def segment_key(segment: Column, key_chars: int | None = None) -> Column:
    """What makes two segments the same: the text in lower case, or only its beginning."""
    low = F.lower(segment)
    return low if key_chars is None else F.substring(low, 1, key_chars)


def extract_all(df: DataFrame, patterns=None, stop_items=None, extra=()) -> DataFrame:
    """Cleaned postings -> (row_id, occupation, skills, responsibilities, extra columns)."""
    none = F.array().cast(EMPTY)

    def col(name, default):
        return F.coalesce(F.col(name), default) if name in df.columns else default

    keyword = extract_items(col("full_text", F.lit("")), patterns, stop_items)
    return (
        df.withColumn("_keywords", keyword)
        .select(
            "row_id", *extra,
            F.coalesce(F.col("category"), F.lit("unknown")).alias("occupation"),
            merge_items(col("technical_skills_parsed", none), col("soft_skills_parsed", none),
                        F.col("_keywords"), stop_items=stop_items).alias("skills"),
            segments(col("description", F.lit("")),
                     col("requirements_text", F.lit(""))).alias("responsibilities"),
        )
    )


def candidate_items(df: DataFrame, text: str = "text", out: str = "skills", patterns=None,
                    stop_items=None, alias_rules=None) -> DataFrame:
    """Adds the items of a document: cleaning, then the same dictionary."""
    cleaned = df.withColumn("_clean", X.clean_text(F.col(text), alias_rules))
    return cleaned.withColumn(out, extract_items(F.col("_clean"), patterns, stop_items)).drop("_clean")
