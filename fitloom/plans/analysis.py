"""Analysis of documents against stored profiles (F6), the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.vectors import HashingEncoder, candidate_text, embed, has_nan
from fitloom.operators import extract, match
from fitloom.plans.materialize import cut


def prepare_documents(docs: DataFrame, make_encoder=HashingEncoder, patterns=None, stop_items=None,
                      alias_rules=None) -> DataFrame:
    """Raw text -> skills and embedding; sections are used where the table has them."""
    none = F.array().cast("array<string>")
    sections = {c: F.coalesce(F.col(c), none) if c in docs.columns else none
                for c in ("experience", "projects")}
    docs = extract.candidate_items(docs, "text", "skills", patterns, stop_items, alias_rules)
    text = candidate_text(F.col("skills"), sections["experience"], sections["projects"],
                          F.col("text"))
    return docs.withColumn("embedding", embed(text, make_encoder))


def analyze(docs: DataFrame, kb: DataFrame, mode: str = "exact",
            alpha: float = rules.SEMANTIC_WEIGHT, beta: float = rules.COVERAGE_WEIGHT,
            threshold: float = rules.SEMANTIC_ITEM_THRESHOLD,
            make_encoder=HashingEncoder, is_stored: bool = False) -> DataFrame:
    """scores and gaps of every document for its target group.

    ``docs``: doc_id (unique), target_key, skills, embedding, and what else belongs to the record
    (`match.RECORD`); ``kb``: key, core_skills, optional_skills, embedding.  Documents with an unusable vector, an unknown
    group or without an id give no row (see ``rejected``).

    Both tables feed several branches, so they are stored first, unless ``is_stored`` says that they are.
    """
    if not is_stored:
        fields = [c for c in ("key", "occupation", "core_skills", "optional_skills", "embedding") if c in kb.columns]
        docs = cut(docs.select(*match.DOC, "embedding", *(c for c in match.RECORD if c in docs.columns)))
        kb = cut(kb.select(*fields))
    usable = docs.filter(~F.coalesce(has_nan(F.col("embedding")), F.lit(False)))
    return match.score_documents(usable, kb, alpha, beta, mode=mode, threshold=threshold, make_encoder=make_encoder)


def rejected(docs: DataFrame, kb: DataFrame) -> DataFrame:
    """Documents that ``analyze`` leaves out, with the reason: id, vector or group."""
    reason = F.when(F.col("doc_id").isNull(), "id").when(F.coalesce(has_nan(F.col("embedding")), F.lit(False)), "vector")
    known = kb.select(F.col("key").alias("target_key"), F.lit(True).alias("_known")).distinct()
    found = docs.join(known, "target_key", "left").withColumn(
        "reason", F.coalesce(reason, F.when(F.col("_known").isNull(), "group")))
    return found.filter("reason is not null").select(*docs.columns, "reason")
