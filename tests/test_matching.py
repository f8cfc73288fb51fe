import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fitloom.functions import vectors as V
from fitloom.operators import match, neighbours
from fitloom.plans.analysis import analyze, prepare_documents, rejected
from fitloom.sources import history
from fitloom.streaming.scoring import score_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the encoder below runs in workers

KB = "key string, core_skills array<struct<item:string,weight:double>>, optional_skills array<struct<item:string,weight:double>>, embedding array<float>"


@pytest.fixture(scope="module")
def kb(spark):
    return spark.createDataFrame([
        ("web", [("React.js", 0.9), ("SQL", 0.5)], [("REST API", 0.2), ("SQL", 0.1), ("css", 0.1)], [1.0, 0.0]),
        ("none", [], [], [0.0, 1.0])], KB)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, "web", ["sql", "SQL", "reactjs", "Cooking"], [0.6, 0.8]),
        (2, "web", [], [-1.0, 0.0]), (3, "none", ["sql"], [0.0, 0.0]), (4, "lost", ["sql"], [1.0, 0.0]),
        (5, "web", ["sql"], [float("nan"), 0.0])],
        "doc_id long, target_key string, skills array<string>, embedding array<float>")


def test_analysis(docs, kb):
    got = {r.doc_id: r for r in analyze(docs, kb).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r.matched_skills == ["React.js", "SQL"] and r.missing_skills == ["REST API"]
    assert r.extra_skills == ["Cooking"]
    assert (r.weighted_skill_score, r.semantic_similarity_score) == (round(1.4 / 1.7, 4), 0.6)
    assert r.match_score == round(0.5 * 0.6 + 0.5 * 1.4 / 1.7, 4)
    assert (got[2].match_score, got[2].semantic_similarity_score) == (0.0, 0.0)
    assert (got[3].weighted_skill_score, got[3].extra_skills) == (0.0, ["sql"])
    assert {(r.doc_id, r.reason) for r in rejected(docs, kb).collect()} == {(4, "group"), (5, "vector")}


def test_last_spelling_of_a_candidate_item_is_shown(docs, kb):
    rows = match.match_rows(docs, kb).filter("doc_id = 1").collect()
    assert {(r["item"], r.candidate) for r in rows} == {("React.js", "reactjs"), ("SQL", "SQL")}


def test_record_is_complete(docs, kb):
    full = docs.withColumns({"user_id": F.lit(7), "cv_filename": F.lit("a.pdf"), "education": F.array(F.lit("x"))})
    row = analyze(full, kb).filter("doc_id = 1").first()
    assert (row.user_id, row.cv_filename, row.education, row.occupation_display) == (7, "a.pdf", ["x"], "Web")
    assert row.core_skills == ["React.js", "SQL"] and row.skills == ["sql", "SQL", "reactjs", "Cooking"]
    saved = history.evaluation_rows(analyze(full, kb), F.lit("2024-05-01 00:00:00")).filter("occupation_key = 'web'").collect()
    assert all(r.user_id == 7 and '"education":["x"]' in r.candidate_profile for r in saved)


def test_one_group_with_nearly_all_documents(spark):
    items = [(f"item {k}", round(1 - k / 400, 4)) for k in range(300)]
    kb = spark.createDataFrame([("hot", items[:150], items[150:], [1.0]), ("cold", items[:5], [], [1.0])], KB)
    rows = [(i, "hot" if i % 10 else "cold", [f"Item {(i * 7 + j) % 400}" for j in range(20)], [1.0]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, target_key string, skills array<string>, embedding array<float>")
    got = {r.doc_id: r for r in analyze(docs, kb).collect()}
    assert len(got) == 2000
    for i in (0, 1, 57, 1999):
        weights = dict(items if i % 10 else items[:5])
        have = {s.lower() for s in rows[i][2]}
        hit = [n for n in weights if n in have]
        assert got[i].matched_skills == sorted(hit, key=lambda n: -weights[n])
        assert got[i].extra_skills == [s for s in rows[i][2] if s.lower() not in weights]
        assert got[i].weighted_skill_score == pytest.approx(sum(weights[n] for n in hit) / sum(weights.values()), abs=1e-4)
    plan = match.match_rows(docs, kb)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


class Letters:
    """Vector of letter counts."""

    def __call__(self, texts):
        out = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def test_semantic_matching(docs, kb):
    rows = match.match_rows(docs, kb, "semantic", 0.5, Letters).collect()
    by = {(r.doc_id, r["item"]): r for r in rows}
    letters = Letters()
    for item in ("REST API", "css"):
        sims = (letters([item]) @ letters(["SQL", "SQL", "React.js", "Cooking"]).T)[0].round(6)
        if sims.max() < 0.5:
            assert (1, item) not in by
            continue
        assert by[1, item].similarity == round(float(sims.max()), 4)
        assert by[1, item].candidate == ["sql", "SQL", "reactjs", "Cooking"][int(sims.argmax())]
    assert by[1, "SQL"].similarity == 1.0 and by[1, "SQL"].candidate == "SQL"
    assert (2, "SQL") not in by


def test_vectors(column):
    assert column(V.has_nan, [[1.0, float("nan")], [1.0]], "array<double>") == [True, False]
    assert column(lambda c: V.semantic_score(c, F.lit([1.0, 0.0])), [[0.0, 0.0], [3.0, 4.0], [-1.0, 0.0]],
                  "array<double>") == [0.0, pytest.approx(0.6), 0.0]
    vec = column(V.embed, ["go go rust", "", None])
    assert np.linalg.norm(vec[0]) == pytest.approx(1.0) and sum(vec[1]) == 0 == sum(vec[2])


def test_raw_documents_to_scores(spark, kb):
    raw = spark.createDataFrame([(1, "web", "We use ReactJS, sql and <b>REST API</b>"), (2, "web", " ")],
                                "doc_id long, target_key string, text string")
    prepared = prepare_documents(raw, lambda: (lambda texts: np.ones((len(texts), 2))))
    got = {r.doc_id: r for r in analyze(prepared, kb).collect()}
    assert got[1].matched_skills == ["React.js", "SQL", "REST API"]
    assert got[2].missing_skills == ["React.js", "SQL", "REST API"]


def test_stream_equals_batch(spark, docs, kb, tmp_path):
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    kb.write.parquet(f"{tmp_path}/kb")
    stored = spark.read.parquet(f"{tmp_path}/kb")

    def run():
        arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        score_stream(arriving, stored, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/history").awaitTermination()

    run()
    run()  # nothing new: nothing is written twice
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").drop("batch_id").collect()))
    assert got == sorted(map(str, analyze(docs, kb).collect()))
    saved = spark.read.parquet(f"{tmp_path}/history")
    assert saved.count() == len(got) and saved.select("id").distinct().count() == len(got)


def test_lost_history_keeps_scores(spark, docs, kb, tmp_path):
    docs.write.parquet(f"{tmp_path}/in")
    kb.write.parquet(f"{tmp_path}/kb")
    (tmp_path / "blocked").write_text("a file where the history folder should be")
    arriving = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    score_stream(arriving, spark.read.parquet(f"{tmp_path}/kb"), f"{tmp_path}/out", f"{tmp_path}/state",
                 f"{tmp_path}/blocked", f"{tmp_path}/rejected").awaitTermination()
    assert {(r.doc_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejected").collect()} == {(4, "group"), (5, "vector")}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_history(spark, docs, kb, tmp_path):
    rows = history.evaluation_rows(analyze(docs, kb), F.lit("2024-05-01 00:00:00"))
    history.append_evaluations(rows, f"{tmp_path}/h")
    stored = spark.read.parquet(f"{tmp_path}/h")
    listed = history.list_evaluations(stored, 2).collect()
    assert len(listed) == 2 and listed[0].id > listed[1].id
    web = {r.id: r for r in history.list_evaluations(stored, 50, "web").collect()}
    assert len(web) == 2 and ["React.js", "SQL"] in [r.matched_skills for r in web.values()]
    assert history.get_evaluation(stored, listed[0].id).count() == 1
    assert history.get_evaluation(stored, -1).count() == 0


def test_items_are_not_shuffled_by_key(docs, kb):
    """Items of a document stay together from its list to its gaps, and repeated keys count once."""
    plan = match.gaps(docs, kb)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any(
        "key#" in part.split("]")[0] and "doc_id" in part.split("]")[0] for part in plan.replace("target_key#", "").split("hashpartitioning(")[1:])
    rows = {r.doc_id: r for r in match.gaps(docs, kb).collect()}
    assert set(rows) == {1, 2, 3, 5} and rows[1].matched_skills == ["React.js", "SQL"] and rows[1].extra_skills == ["Cooking"]
    assert round(rows[1].weighted, 6) == round(1.4 / 1.7, 6) and rows[2].extra_skills == [] and rows[3].extra_skills == ["sql"]


def test_similar_mode_broadcasts_no_candidates(docs, kb):
    plan = match.match_rows(docs, kb, "semantic", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2


def test_pairs_of_similar_items_are_not_shuffled(spark):
    """Exact before similar, then the best similarity, then the first place; nothing is dealt out by (document, item)."""
    kb = spark.createDataFrame([("g", [("red plate", 0.9), ("blue plate", 0.5)], [("red cup", 0.2)], [1.0]), ("h", [("red plate", 0.3)], [], [1.0])], KB)
    docs = spark.createDataFrame([
        (1, "g", ["red plate", "green plate", "RED PLATE"]), (2, "g", ["green cup", "blue cup"]), (3, "h", ["plate", "cup"]), (4, "h", []), (None, "h", ["red cup"]),
        (None, "h", ["red plate"])],
        "doc_id long, target_key string, skills array<string>")
    rows = match.match_rows(docs, kb, "semantic", 0.45)
    got = {(r.doc_id, r["item"]): (r.weight, r.candidate, r.similarity, r.key) for r in rows.collect()}
    assert got == {
        (1, "red plate"): (0.9, "RED PLATE", 1.0, "red plate"), (1, "blue plate"): (0.5, "red plate", 0.5, "red plate"),
        (1, "red cup"): (0.2, "red plate", 0.5, "red plate"),
        (2, "blue plate"): (0.5, "blue cup", 0.5, "blue cup"), (2, "red cup"): (0.2, "green cup", 0.5, "green cup"),
        (3, "red plate"): (0.3, "plate", 0.7071, "plate"), (None, "red plate"): (0.3, "red plate", 1.0, "red plate")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(doc_id" in line and "item" in line]
