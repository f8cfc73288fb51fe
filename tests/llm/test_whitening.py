import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitloom.llm import whitening

KIND = "vec_id long, embedding array<float>, label int"


def usable(rows):
    ok = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 2**50 for x in v)]
    sizes = [len(v) for _, v in ok]
    dim = max(sorted(set(sizes)), key=sizes.count)
    return [(i, [math.floor(1024 * x) + 100_000 for x in v]) for i, v in ok if len(v) == dim]


def rows(dim=12, n=150):
    random = np.random.RandomState(4)
    basis = random.randn(dim, dim) * np.linspace(3, 0.2, dim)
    out = [(None if k % 40 == 9 else k, (random.randn(dim) @ basis).tolist(), 0) for k in range(n)]
    out += [out[3]] * 30 + [(900, None, 0), (901, [], 0), (902, [float("nan")] * dim, 0), (903, [None, *[1.0] * (dim - 1)], 0),
                            (904, [float("inf")] * dim, 0), (905, [1.0, 2.0], 1), (906, [3e38] * dim, 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in out]


@pytest.mark.parametrize("columns, entries", [(1024, 1 << 18), (5, 35)])
def test_whitened_vectors(spark, monkeypatch, columns, entries):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    own = rows()
    df = spark.createDataFrame(own, KIND).repartition(3, "vec_id").withColumn("x", F.lit("a")).withColumn("index", F.lit(1)).withColumn("at", F.lit(1))
    got = whitening.whitened_vectors(df).collect()
    left = usable(own)
    n, sums = len(left), [sum(c) for c in zip(*(x for _, x in left))]
    dev = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for _, x in left]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in left])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    by_component = defaultdict(list)
    for r in got:
        by_component[r.component].append(r)
    assert sorted(by_component) == list(range(1, 9))
    none = lambda i: -1 if i is None else i
    for k, found in by_component.items():
        assert found[0].explained == pytest.approx(values[k - 1] / np.trace(centred.T @ centred / n), rel=1e-9)
        a = sorted((none(r.vec_id), r.deviation, r.whitened) for r in found)
        far = int(np.abs(want[:, k - 1]).argmax())
        sign = next(1.0 if (w > 0) == (want[far, k - 1] > 0) else -1.0 for _, d, w in a if d == dev[far] and abs(abs(w) - abs(want[far, k - 1])) < 1e-6)
        b = sorted((none(i), d, sign * w) for (i, _), d, w in zip(left, dev, want[:, k - 1]))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_deviations_are_exact():
    x = np.array([[1 << 60, -(1 << 59)], [5, 7], [0, 1]], np.int64)
    n, sums = 10**9, [3 * 10**9 + 1, -7]
    dev, centred = whitening.exact_centred(x, n, sums)
    assert dev == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    assert centred[1].tolist() == [float(Fraction(n * 5 - sums[0], n)), float(Fraction(n * 7 - sums[1], n))]
    small = np.array([[5, 7], [0, 1]], np.int64)
    assert whitening.exact_centred(small, 2, [5, 8])[0] == [25 + 36, 25 + 36]


def test_components_without_variance(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0, 3.0], 0) for k in range(4)], KIND)
    got = whitening.whitened_vectors(same).collect()
    assert len(got) == 12 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    line = spark.createDataFrame([(k, [float(k), 2.0], 0) for k in range(4)], KIND)
    got = {(r.vec_id, r.component): r for r in whitening.whitened_vectors(line).collect()}
    assert got[0, 1].explained == pytest.approx(1) and got[0, 2].whitened is None and abs(got[0, 1].whitened) == pytest.approx(1.5 / 1.25 ** 0.5)


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None, 0), (2, [], 0)], KIND)
    got = whitening.whitened_vectors(empty)
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_index_has_no_gaps(spark):
    df = whitening.stored(spark.range(1000).repartition(7).filter("id % 3 = 0"))
    assert sorted(r["index"] for r in whitening.indexed(df).collect()) == list(range(334))
