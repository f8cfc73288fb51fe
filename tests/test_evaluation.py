import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.operators import evaluate, extract, lexical
from fitloom.plans import skew
from fitloom.plans.evaluation import blend_inputs


def ranks(values):
    order = np.sort(values)
    return np.array([(np.searchsorted(order, v) + np.searchsorted(order, v, side="right") + 1) / 2 for v in values])


def spearman(x, y):
    return np.corrcoef(ranks(x), ranks(y))[0, 1]


def test_rank_correlation_ignores_incomplete_rows_on_both_sides(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, None), (None, 9.0), (4.0, 4.0), (5.0, 3.0), (None, 1.5), (0.5, None), (None, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    full = np.array([r for r in rows if None not in r])
    for a, b in (("x", "y"), ("y", "x")):
        assert evaluate.spearman(df, a, b).first()[0] == pytest.approx(spearman(full[:, 0], full[:, 1]))


def test_rank_correlation_with_hot_values(spark):
    random = np.random.RandomState(3)
    x = np.where(random.rand(3000) < 0.6, 0.0, random.randint(0, 50, 3000) / 50)
    y = np.where(random.rand(3000) < 0.5, 1.0, x + random.randint(0, 9, 3000) / 9)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), ["a", "b", "c"] * 1000)), "x double, y double, g string")
    got = {r.g: r.spearman for r in evaluate.spearman(df, "x", "y", ("g",)).collect()}
    for k, g in enumerate("abc"):
        assert got[g] == pytest.approx(spearman(x[k::3], y[k::3]))


def test_repeated_pairs_change_nothing(spark):
    rows = [(1, "go rust go", "go is fast", 0.5), (2, "sql", "we use sql", 0.9), (3, "", "", 0.1)]
    schema = "pair_id long, sentence1 string, sentence2 string, label double"
    plain = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame([(1, *r[1:]) for r in rows], schema)
    for fn in (lexical.bm25, lexical.tfidf_cosine, lexical.tfidf_cosine):
        assert sorted(r.pred for r in fn(plain).collect()) == pytest.approx(sorted(r.pred for r in fn(same).collect()))
    twice = plain.union(plain)
    assert lexical.bm25(twice).count() == 6 == blend_inputs(twice, patterns=["go"], stop_items=[]).count()
    assert lexical.tfidf_cosine(plain, 1).filter("pred > 0").count() == 1


def test_unused_columns_are_not_read(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b", 0.5, "en", "x")], "pair_id long, resume_text string, job_text string, "
                          "ai_match_score double, lang string, other string").write.parquet(f"{tmp_path}/p")
    pairs = extract.clean_pairs(spark.read.parquet(f"{tmp_path}/p"), []).filter("lang = 'en'").select("pair_id", "resume_text")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "other" not in schema and "ai_match_score" not in schema
    assert "EqualTo(lang,en)" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert pairs.collect() == [(1, "a")]


def test_words_of_a_pair_are_counted_without_a_shuffle(spark):
    words = spark.createDataFrame([(0, 7, 0.5, ["b", "a", "b", "b a"], ["b", "c"]), (1, 7, 0.5, [], []), (2, 8, 0.1, None, ["x", "x"])],
                                  "_row long, pair_id long, label double, words1 array<string>, words2 array<string>")
    events = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("count words", "")
    counts = lexical._term_counts(words.fillna(0))
    stages = [s for j in events.getJobIdsForGroup("count words") for s in events.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1  # read, count and store
    got = sorted(((r._row, r.term, r.n1, r.n2) for r in counts.collect()), key=str)
    assert got == [(0, "a", 1, 0), (0, "b a", 1, 0), (0, "b", 2, 1), (0, "c", 0, 1), (1, None, 0, 0), (2, None, 0, 0)]


def test_overlap_of_items_spelled_with_a_line_break(spark, tmp_path):
    from fitloom.catalog import base, evaluation

    texts = ["more of\nthe same", "more of the same", "less of\nThe same"]
    spark.createDataFrame([(i, t, "en", "x", 20) for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string, source string, n_chars long"
                          ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    t = base.Inputs(spark, str(tmp_path))
    got = {r.pair_id: r.overlap for r in evaluation.item_overlap(t).collect()}
    # as its SQL, which compares items as they stand: "the" is met, "of the" is not "of\\nthe"
    assert got == {i: 1.0 if i % 3 == 2 else 0.5 for i in range(8)}
    swept = evaluate.item_overlap(F.lit(texts[0]), F.lit(texts[1]), [r"\bof\s+the\b"], [])
    assert spark.range(1).select(swept).first()[0] == 1.0  # the operator's own key squeezes blanks


def test_sweep_by_brute_force(spark):
    random = np.random.RandomState(1)
    s, o, y = random.randint(0, 20, 400) / 20, random.randint(0, 4, 400) / 4, random.randint(0, 6, 400) / 6
    df = spark.createDataFrame(list(zip(s.tolist(), o.tolist(), y.tolist())), "semantic double, overlap double, label double")
    got = {r.alpha: r for r in evaluate.alpha_sweep(df.union(df.limit(0))).collect()}
    for alpha in (0.0, 0.3, 1.0):
        mixed = alpha * s + (1 - alpha) * o
        assert got[alpha].pearson == pytest.approx(np.corrcoef(mixed, y)[0, 1], abs=1e-4)
        assert got[alpha].rmse == pytest.approx(np.sqrt(np.mean((mixed - y) ** 2)), abs=1e-4)
    assert sum(r.is_best for r in got.values()) == 1
    assert got[0.0].spearman == pytest.approx(spearman(o, y), abs=1e-4)


@pytest.mark.parametrize("parts", [1, 6, 1 << 16])
def test_frequent_terms_are_broadcast(spark, parts):
    random = np.random.RandomState(2)
    words = ["the", "a"] * 6 + [f"word{k}" for k in range(40)]
    text = lambda: " ".join(random.choice(words, random.randint(0, 12)))
    rows = [(i, text(), text(), 0.5) for i in range(80)] + [(90, "", "", 0.1), (91, "the", "the", 0.2)]
    pairs = spark.createDataFrame(rows, "pair_id long, sentence1 string, sentence2 string, label double")
    for fn in (lexical.tfidf_cosine, lexical.bm25):
        want = {r.pair_id: r.pred for r in fn(pairs, parts=1 << 30).collect()}
        got = {r.pair_id: r.pred for r in fn(pairs, parts=parts).collect()}
        assert got == pytest.approx(want) and len(got) == 82 and sum(v != 0 for v in got.values()) > 30


def test_join_by_weight(spark):
    rows = spark.createDataFrame([("hot",)] * 500 + [(f"k{i}",) for i in range(100)] + [(None,), ("lost",)], "k string")
    table = rows.filter("k is not null and k <> 'lost'").groupBy("k").agg(F.count("*").alias("n"))
    for parts in (1, 3, 1024, 10**6):
        out = skew.join_by_weight(rows, table, "k", "n", rows.count(), parts)
        assert out.groupBy("k", "n").count().filter("n <> count").count() == 0 and out.count() == 600
    assert {r.k for r in skew.heavy_keys(table, "n", 602, 3).collect()} == {"hot"}


def test_pairs_are_dealt_out_before_they_are_cleaned(spark):
    """One input split with all pairs does not leave all the cleaning to one task."""
    one = spark.createDataFrame([(k, f"some text {k}", f"a job {k}", 50.0) for k in range(400)],
                                "pair_id long, resume_text string, job_text string, ai_match_score double").coalesce(1)
    for rows in (evaluate.labelled_pairs(one), extract.clean_pairs(one, [])):
        assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 400
