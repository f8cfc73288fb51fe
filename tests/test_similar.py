import hashlib
import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fitloom.functions import vectors as V
from fitloom.operators import cells, neighbours, similar


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the encoders below run in workers


class Small(V.HashingEncoder):
    dim = 37


def hashed(text, dim=256):
    out = np.zeros(dim)
    for w in re.findall(r"\w+", (text or "").lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    return (out / (np.linalg.norm(out) or 1)).astype(np.float32).astype(float)


class Letters:
    """Vectors of letter counts, not of length one."""

    def __call__(self, texts):
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float) / 3


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["senior", "engineer", "Đà", "nẵng", "c++"]
    def name(k):
        own = [rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3, 3, 4, 6, 40]))]
        # a third of all names share two words
        return " ".join(["Senior", *own[:2], "ENGINEER"]) if k % 3 == 0 else ", ".join(own)
    return [[name(k) for k in range(n)] + ["", " - ", None, "w1 w1 w1 w2"] for n in (260, 300)]


def test_default_encoder_is_an_expression(spark, names):
    texts = names[0] + ["x " * 3000 + "y", "İı ß ² _a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for encoder in (V.HashingEncoder, Small):
        out = df.select("i", V.embed(F.col("t"), encoder).alias("v"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        for r in out.collect():
            if r.i < len(texts) - 1:  # lower case of U+0130 differs
                assert np.allclose(r.v, hashed(texts[r.i], encoder.dim), atol=1e-7), texts[r.i]


@pytest.mark.parametrize("encoder", [V.HashingEncoder, Small])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.97])
def test_prefix_pairs(spark, names, encoder, threshold):
    sides = [spark.createDataFrame([(n,) for n in own], "name string").distinct() for own in names]
    distinct = [sorted({n for n in own if n is not None}) for own in names]
    x, y = (np.array([hashed(n, encoder.dim) for n in own]) for own in distinct)
    sims = np.round(x @ y.T, 6)
    want = {(distinct[0][i], distinct[1][j]): sims[i, j] for i, j in np.argwhere(sims >= threshold)}
    got = {(r.left_name, r.right_name): r.similarity for r in similar.similar_names(*sides, threshold, encoder).collect()}
    edge = {p for p in set(want) ^ set(got) if abs(sims[distinct[0].index(p[0]), distinct[1].index(p[1])] - threshold) <= 1.1e-6}
    assert set(want) ^ set(got) == edge
    assert all(abs(got[p] - want[p]) < 2e-6 for p in set(want) & set(got))
    plan = similar.similar_names(*sides, threshold, encoder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_prefixes_leave_most_pairs_out(spark):
    rnd = random.Random(1)
    words = [f"term{k}" for k in range(400)]
    own = [[" ".join(rnd.sample(words, 3)) for _ in range(500)] for _ in range(2)]
    left, right = (similar._sparse(spark.createDataFrame([(n,) for n in sorted(set(o))], "name string"), V.HashingEncoder) for o in own)
    found = similar.prefix_candidates(left, right, 0.75, 256).count()
    assert found < left.count() * right.count() / 500


def test_keys_of_names_are_not_broadcast(spark):
    sides = [similar._sparse(spark.createDataFrame([(f"a{k} b{k % 3}",) for k in range(9)], "name string"), V.HashingEncoder) for _ in range(2)]
    plan = similar.prefix_candidates(*sides, 0.6, 256)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        similar.similar_names(*[spark.createDataFrame([("a",)], "name string")] * 2, 0.0)


@pytest.mark.parametrize("pivots, rows", [(256, 4096), (5, 7), (1, 20)])
def test_pivot_pairs(spark, names, pivots, rows):
    sides = [spark.createDataFrame([(n,) for n in own], "name string").filter("name is not null").distinct() for own in names]
    distinct = [sorted({n for n in own if n is not None}) for own in names]
    x, y = (Letters()(own).astype(np.float32).astype(float) for own in distinct)
    sims = np.round(x @ y.T, 6)
    want = {(distinct[0][i], distinct[1][j], sims[i, j]) for i, j in np.argwhere(sims >= 1.4)}
    got = similar.pivot_pairs(*sides, 1.4, Letters, pivots, rows).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("block_rows, pivots", [(2, 4), (100, 256), (10**6, 256), (7, 1)])
def test_nearest_groups(spark, block_rows, pivots):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((9, 8)) * 3
    vec = lambda n: [(i, (centres[i % 9] + rng.standard_normal(8) * 0.1).tolist()) for i in range(n)]
    left, right = vec(60), vec(90)
    right += [(100 + i, v) for i, v in right[:9]] + [(200, [0.0] * 8)]
    q = spark.createDataFrame(left + [(900, None), (901, [0.0] * 8)], "query_id long, vector array<double>")
    g = spark.createDataFrame(right + [(901, None)], "group_id long, vector array<double>")
    seen = {}
    got = neighbours.nearest_groups(q, g, 4, pivots, block_rows, on_visits=lambda visits, facts: seen.update(n=visits.filter("query_id < 900").count(), cells=(facts.rows > 0).sum()))
    rows = sorted((r.query_id, r["rank"], r.group_id, r.similarity) for r in got.collect())
    a, b = np.array([v for _, v in left] + [[0.0] * 8]), np.array([v for _, v in right])
    sims = (a @ b.T).round(6)
    want = []
    for (i, _), s in zip(left + [(901, 0)], sims):
        order = sorted(range(len(right)), key=lambda j: (-s[j], right[j][0]))[:4]
        want += [(i, k + 1, right[j][0], s[j]) for k, j in enumerate(order)]
    assert [(*r[:3], round(r[3] + 0.0, 6)) for r in rows] == [(*w[:3], round(float(w[3]) + 0.0, 6)) for w in sorted(want)]
    if pivots > 4:
        assert seen["n"] < 0.8 * seen["cells"] * len(left), seen  # cells left out


def test_nearest_groups_of_few(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    g = spark.createDataFrame([(7, [0.5, 0.0]), (8, [-1.0, 0.0])], "group_id long, vector array<double>")
    assert [(r.group_id, r.similarity, r["rank"]) for r in neighbours.nearest_groups(q, g, 3).orderBy("rank").collect()] == [(7, 0.5, 1), (8, -1.0, 2)]
    assert neighbours.nearest_groups(q, g.limit(0), 3).count() == 0 and neighbours.nearest_groups(q.limit(0), g, 3).count() == 0
