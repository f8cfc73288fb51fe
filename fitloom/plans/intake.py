"""Uploads to scores in one plan: gate, sections, analysis, history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.vectors import HashingEncoder
from fitloom.operators import match
from fitloom.plans.analysis import analyze, prepare_documents, rejected
from fitloom.plans.materialize import cut
from fitloom.sources.history import evaluation_rows
from fitloom.sources.uploads import ingest_gate


class Intake(NamedTuple):
    """status: (doc_id, filename, target_key, status, reason) of every upload; scores: one row per scored
    document; history: its rows for the evaluation history."""

    status: DataFrame
    scores: DataFrame
    history: DataFrame


def score_uploads(uploads: DataFrame, kb: DataFrame, created_at: Column, make_encoder=HashingEncoder, patterns=None, stop_items=None,
                  alias_rules=None, max_chars: int | None = None, **options) -> Intake:
    """Score all uploads (doc_id, filename, n_bytes, body, target_key, and columns of `match.RECORD`) that pass the gate.

    The gate comes first, so texts that fail it are neither cleaned nor encoded. An upload that passes and still can't
    be scored has a reason: its vector, or no id. ``options`` go on to `analyze`.
    """
    fields = [c for c in ("key", "occupation", "core_skills", "optional_skills", "embedding") if c in kb.columns]
    kb = cut(kb.select(*fields))
    gate = cut(ingest_gate(uploads, kb.select("key"), max_chars))
    record = [c for c in match.RECORD if c in gate.columns and c not in ("cv_filename", "skills")]
    passed = gate.filter("status = 200").select("doc_id", "target_key", F.col("section_text").alias("text"), F.col("filename").alias("cv_filename"), *record)
    docs = cut(prepare_documents(passed, make_encoder, patterns, stop_items, alias_rules))
    scores = cut(analyze(docs, kb, make_encoder=make_encoder, is_stored=True, **options))
    lost = rejected(docs, kb).select("doc_id", "target_key", "cv_filename", "reason")
    same = gate["doc_id"].eqNullSafe(lost["doc_id"]) & (gate["target_key"] == lost["target_key"]) & (gate["filename"] == lost["cv_filename"]) & (gate["status"] == 200)
    status = gate.join(lost, same, "left").select(gate["doc_id"], gate["filename"], gate["target_key"], "status", "reason")
    return Intake(status, scores, evaluation_rows(scores, created_at))
