import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fitloom.operators import evaluate, hierarchy, profile, variants
from fitloom.plans import offline

WORDS = ["Go", "go", "Rust", "rust ", "SQL", "sql", "Kafka", "REST API", "REST API APIs", "Excel", "x"]


@pytest.fixture(scope="module")
def records(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        group = random.choice(["Data Eng", "Data Eng", "Web", "Ops", "unknown", ""])
        items = random.choices(WORDS, k=random.randint(0, 5))
        segs = [f"segment number {random.randint(0, 30)} of {group}" for _ in range(2)] + ["short"]
        rows.append((i, group, items, segs))
    df = spark.createDataFrame(rows, "row_id long, occupation string, skills array<string>, responsibilities array<string>")
    return rows, profile.known_groups(df)


def brute_weights(rows):
    counts, sizes = defaultdict(Counter), Counter()
    for _, group, items, _ in rows:
        if group in ("", "unknown"):
            continue
        key = group.lower().replace(" ", "_")
        sizes[key] += 1
        seen = set()
        for item in items:
            item = item.strip()
            if len(item) >= 2 and item.lower() not in seen:
                seen.add(item.lower())
                counts[key][item] += 1
    kept = {k: {i: n for i, n in c.items() if n >= max(2, int(sizes[k] * 0.01))} for k, c in counts.items()}
    df = Counter(low for c in kept.values() for low in {i.lower() for i in c})
    out = {}
    for k, c in kept.items():
        freq = {i: round(n / sizes[k], 6) for i, n in c.items()}
        raw = {i: f * math.log(1 + len(sizes) / (1 + df[i.lower()])) for i, f in freq.items()}

        def scaled(d):
            lo, hi = min(d.values()), max(d.values())
            return {i: 0.5 if hi == lo else round((v - lo) / (hi - lo), 6) for i, v in d.items()}
        f, t = scaled(freq), scaled(raw)
        for i in c:
            out[k, i] = round(0.8 * f[i] + 0.2 * t[i], 4)
    return out, sizes


def test_weights_equal_brute_force(records):
    rows, df = records
    parts = offline.profile_parts(df)
    expected, sizes = brute_weights(rows)
    got = {(r.occ_key, r["item"]): r.weight for r in parts["weights"].collect()}
    assert got == expected
    assert {r.occ_key: r.jd_count for r in parts["sizes"].collect()} == dict(sizes)
    assert all(0 <= w <= 1 for w in got.values())


def test_long_and_list_input_agree(records):
    _, df = records
    lists = profile.item_support(profile.item_rows_from_lists(df))
    long = df.select("occ_key", "row_id", F.posexplode("skills").alias("pos", "item"))
    rows = profile.item_support(profile.item_rows_from_long(long))
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, rows.select(*lists.columns).collect()))


def test_folded_support_merges_case(records):
    _, df = records
    folded = profile.item_support(profile.item_rows_from_lists(df), fold_case=True)
    assert folded.count() == folded.select("occ_key", F.lower("item")).distinct().count()


def test_segments_keep_first_sight(records):
    rows, df = records
    seen = defaultdict(dict)
    for _, group, _, segs in rows:
        if group not in ("", "unknown"):
            for s in segs:
                if len(s) >= 15:
                    seen[group.lower().replace(" ", "_")].setdefault(s.lower()[:80], s)
    got = {r.occ_key: r.responsibilities for r in profile.nest_segments(profile.group_segments(df, limit=9)).collect()}
    assert got == {k: list(v.values())[:9] for k, v in seen.items()}


def test_variants_are_merged(spark):
    rows = [("a", "Kế toán", 0.9, "core"), ("a", "kế toán", 0.3, "optional"), ("b", "kế toán", 0.5, "core"),
            ("c", "kế toán", 0.4, "core"), ("a", "erp", 0.2, "optional"), ("a", "ERP", 0.4, "core"), ("b", "Zed", 0.1, "optional")]
    df = spark.createDataFrame(rows, "occ_key string, item string, weight double, tier string")
    got = {tuple(r) for r in variants.clean_weighted_profiles(df).collect()}
    assert got == {("a", "Kế toán", 0.9, "core"), ("b", "Kế toán", 0.5, "core"), ("c", "Kế toán", 0.4, "core"),
                   ("a", "ERP", 0.4, "core"), ("b", "Zed", 0.1, "optional")}
    stats = {r.occ_key: r for r in variants.cleaning_stats(df, variants.clean_weighted_profiles(df)).collect()}
    assert (stats["a"].opt_before, stats["a"].opt_after) == (2, 0)


def test_sub_positions_use_their_own_corpus(spark):
    rows = [(i, "p", "s1" if i % 2 else "s2", ["Go", "SQL"] if i % 2 else ["Go"]) for i in range(8)]
    rows += [(i, "q", "s1", ["Go"]) for i in range(8, 12)]
    df = spark.createDataFrame(rows, "row_id long, parent string, occ_key string, skills array<string>") \
        .withColumn("occupation", F.col("occ_key"))
    got = {(r.parent, r.occ_key, r["item"]): r.weight for r in hierarchy.sub_weights(df).collect()}
    # in field q "Go" is the only item: both scaled scores are 0.5
    assert got[("q", "s1", "Go")] == 0.5
    assert got[("p", "s1", "SQL")] == 0.6  # same frequency as Go, but in one group only
    assert got[("p", "s1", "Go")] == 0.4


def test_ranks_and_split_at_small_parts(spark, monkeypatch):
    random.seed(3)
    values = [random.choice([0.1, 0.1, 0.2, random.random()]) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pair_id long, label double")
    monkeypatch.setattr(evaluate, "RANK_PARTS", 16)
    got = {r.label: r.rank for r in evaluate.average_ranks(df, "label").collect()}
    order = sorted(values)
    for v in set(values):
        first = order.index(v) + 1
        assert got[v] == first + (order.count(v) - 1) / 2
    split = evaluate.stratified_split(df)
    per_bucket = split.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("is_val").alias("v")).collect()
    assert all(r.v == round(r.n * 0.1) for r in per_bucket)
    assert sum(r.n for r in per_bucket) == 2000


@pytest.mark.parametrize("parts", [64, 3, 1])
def test_one_group_is_ranked_in_many_parts(spark, parts):
    rows = [(i * 3, "hot" if i % 3 else f"g{i % 7}", [f"segment number {(i * j) % 4000:05d} of the text" for j in range(3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, occ_key string, responsibilities array<string>")
    seen = defaultdict(dict)
    for _, group, segs in rows:
        for s in segs:
            seen[group].setdefault(s, len(seen[group]) + 1)
    want = {(g, r, s) for g, own in seen.items() for s, r in own.items()}
    ranked = profile.group_segments(df, parts=parts)
    assert {(r.occ_key, r["rank"], r.seg) for r in ranked.collect()} == want
    some = profile.group_segments(df, limit=5, parts=parts)
    assert {(r.occ_key, r["rank"], r.seg) for r in some.collect()} == {w for w in want if w[1] <= 5}
    sizes = profile.row_ranges(profile.first_segments(df), parts).filter("occ_key = 'hot'").groupBy("_part").count().collect()
    assert len(sizes) == parts and max(r["count"] for r in sizes) <= 2 * len(seen["hot"]) / parts + 10
    lists = {r.occ_key: r.responsibilities for r in profile.nest_segments(ranked, limit=4).collect()}
    assert lists == {g: list(own)[:4] for g, own in seen.items()}
    assert profile.group_segments(df.filter("row_id < 0"), parts=parts).count() == 0


def test_long_rows_are_not_sorted_before_they_are_dealt_out(spark):
    rows = spark.createDataFrame([("g", 1, 2, "Ab"), ("g", 1, 1, " aB "), ("g", 2, 1, "ab"), ("h", 1, 1, "ab"), ("g", 1, 3, "x")],
                                 "occ_key string, row_id long, pos int, item string")
    out = profile.item_rows_from_long(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Aggregate" not in plan.split("Exchange")[1]
    assert sorted((r.occ_key, r.item, r.seen.row_id, r.seen.seen.pos) for r in out.collect()) == [
        ("g", "aB", 1, 1), ("g", "ab", 2, 1), ("h", "ab", 1, 1)]


def test_lists_of_a_large_group_are_made_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK_SEGMENTS", 4)
    segs = spark.range(50).selectExpr("if(id < 40, 'a', 'gone') AS occ_key", "id + 1 AS rank", "concat('s', id) AS seg").repartition(7)
    sizes = spark.createDataFrame([("a", 9, "A"), ("b", 1, "B")], "occ_key string, jd_count long, occupation string")
    weights = spark.createDataFrame([("a", "x", 0.5, "core")], "occ_key string, item string, weight double, tier string")
    assert all(len(r.block.segs) <= 4 for r in profile.segment_blocks(segs).collect())
    out = profile.enrich(weights, sizes, segs)
    assert out.columns == ["occ_key", "jd_count", "occupation", "core_skills", "optional_skills", "responsibilities"]
    got = {r.occ_key: (r.jd_count, r.occupation, [tuple(s) for s in r.core_skills], r.optional_skills, r.responsibilities) for r in out.collect()}
    assert got == {"a": (9, "A", [("x", 0.5)], [], [f"s{i}" for i in range(40)]), "b": (1, "B", [], [], [])}
    assert [r.responsibilities for r in profile.enrich(weights, sizes, segs, segment_limit=6).filter("occ_key = 'a'").collect()] == [[f"s{i}" for i in range(6)]]


def test_basket_items_move_once(spark):
    """One shuffle, in which a text stands once; spellings of a row still meet and the first one stays."""
    rows = spark.createDataFrame([("g", 1, 2, "Red cup"), ("g", 1, 1, " red CUP "), ("g", 2, 1, "red cup"), ("h", 1, 1, "red cup"), ("g", None, 1, "red cup"), ("g", 1, 3, "x")],
                                 "occ_key string, row_id long, pos int, item string")
    got = profile.item_rows_from_long(rows)
    assert sorted((r.occ_key, r["item"], r.seen.row_id, r.seen[1].pos) for r in got.filter("seen.row_id is not null").collect()) == [
        ("g", "red CUP", 1, 1), ("g", "red cup", 2, 1), ("h", "red cup", 1, 1)]
    assert got.count() == 4
    above, _, below = got._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning")
    assert "Exchange" not in below and "Exchange" not in above and "lower(" not in below.split("\n", 1)[1]
