import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fitloom.llm import components, exact_dedup, simhash, vector_dedup


def ids(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact_groups(docs, brute):
    rows = ids(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.normalised(t)].append(brute.BIG if i is None else i)
    least = lambda t: None if min(groups[t]) == brute.BIG else min(groups[t])
    want = Counter((i, least(n), len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, n in ((i, brute.normalised(t)) for i, t in rows))
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_names_that_collide_are_told_apart(docs, brute, monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh64_intdigest", lambda c: (1 << 63) + len(c) % 3)
    table = exact_dedup.recipes(docs.limit(40)).selectExpr(
        "row", "doc_id", "text_sha256", "transform(names, x -> pmod(x, 3)) as names", "proofs").cache()
    lists = exact_dedup.identified(table).collect()
    by_list = defaultdict(set)
    for r in lists:
        by_list[tuple(r.names), r.variants].add(r.text_sha256)
    assert len(by_list) == len({r.text_sha256 for r in lists}) and all(len(x) == 1 for x in by_list.values())


def test_chunks_are_bounded_and_found_again():
    random = np.random.RandomState(0)
    text = random.randint(97, 123, 200_000).astype(np.uint8)
    ends = exact_dedup.cut_points(text, exact_dedup.rolling(text))
    moved = np.concatenate((text[:5000], text[7000:]))
    others = exact_dedup.cut_points(moved, exact_dedup.rolling(moved))
    assert ends[-1] == len(text) and max(np.diff([0, *ends])) <= exact_dedup.CHUNK_MOST
    assert len(set(e - 2000 for e in ends if e > 8000) & set(others)) > 0.9 * sum(e > 8000 for e in ends)
    same = exact_dedup.cut_points(np.zeros(50_000, np.uint8), exact_dedup.rolling(np.zeros(50_000, np.uint8)))
    assert max(np.diff([0, *same])) <= exact_dedup.CHUNK_MOST


def fingerprint(words):
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_near_groups(docs, brute):
    rows = ids(docs)
    prints = np.array([fingerprint(brute.words(t)) for _, t in rows], np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4) if j > i]
    roots, least = brute.roots(len(rows), links), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, brute.BIG), brute.BIG if i is None else i)
    want = Counter((i, f"{int(p):016x}", None if least[r] == brute.BIG else least[r]) for (i, _), p, r in zip(rows, prints, roots))
    got = simhash.near_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(set(roots))


@pytest.mark.parametrize("heavy, few", [(4096, 16), (20, 4), (6, 3)])
def test_near_links_connect_what_brute_force_does(spark, brute, monkeypatch, heavy, few):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "HALF", heavy // 2)
    monkeypatch.setattr(simhash, "FEW", few)
    random = np.random.RandomState(heavy)
    prints = set()
    for centre in random.randint(0, 1 << 62, 40).tolist():
        for _ in range(60 if centre % 5 else 1):
            flips = random.choice(64, random.randint(0, 6), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    prints = np.array(sorted(prints), np.uint64)
    links = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4) if j > i]
    want = brute.roots(len(prints), links)
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    found = simhash.near_links(df).collect()
    assert brute.roots(len(prints), [(place[r.a], place[r.b]) for r in found]) == want
    assert len(found) < 35 * 20 * len(prints)


def test_components(spark, brute):
    random = np.random.RandomState(2)
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)] + random.randint(1000, 1400, (250, 2)).tolist()
    df = spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    roots = brute.roots(1400, links)
    assert got == {i: r for i, r in enumerate(roots) if r != i}
    assert components.components(df.filter("a < 0")).count() == 0


def vectors():
    random = np.random.RandomState(0)
    rows = [(k, random.randn(24).tolist(), k % 3) for k in range(60)]
    for k in range(600):
        _, v, label = rows[k % 4 if k < 300 else k % 60]
        rows.append((1000 + k, (np.array(v) + random.randn(24) * random.choice([0.05, 0.15, 0.3])).tolist(), label))
    bad = [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [], [float("inf"), *[1.0] * 23]]
    rows += [(2000 + k, v, 1) for k, v in enumerate(bad)] + [(2010, rows[0][1], None), (2011, [1.0, 2.0], 1), (2012, [2.0, 4.0], 1), (2013, [-0.0, 1.0], 1), (2014, [0.0, 1.0], 1)]
    return rows + [(3000 + k, rows[3][1], rows[3][2]) for k in range(20)] + [(3000, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("task_rows", [2048, 50])
def test_near_vectors(spark, brute, monkeypatch, task_rows):
    monkeypatch.setattr(vector_dedup, "TASK_ROWS", task_rows)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in vectors()]
    ok = np.array([l is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows])
    unit = np.zeros((len(rows), 24))
    for k in np.flatnonzero(ok):
        v = np.array(rows[k][1])
        unit[k, :len(v)] = v / np.linalg.norm(v)
    label = np.array([-1 if l is None else l for *_, l in rows])
    dim = np.array([len(v or []) for _, v, _ in rows])
    linked = (unit @ unit.T >= 0.93) & ok & ok[:, None] & (label == label[:, None]) & (dim == dim[:, None])
    np.fill_diagonal(linked, False)
    roots, least = brute.roots(len(rows), np.argwhere(np.triu(linked)).tolist()), {}
    for (i, _, _), r in zip(rows, roots):
        least[r] = min(least.get(r, brute.BIG), i)
    want = Counter((i, int(n), least[r], least[r] == i) for (i, _, _), n, r in zip(rows, linked.sum(1), roots))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as rep", "1 as row")
    assert Counter(tuple(r) for r in vector_dedup.near_vectors(df).collect()) == want


@pytest.mark.parametrize("size", [3, 7, 100])
def test_tasks_hold_few_visitors(size):
    rows = [("a", 2, 0, k, 0, home, 100 * k + n, 1, [1.0, 0.0]) for k, own, far in ((0, 4, 23), (1, 1, 0), (2, 2, 5), (3, 3, 10))
            for home, count in ((True, own), (False, far)) for n in range(count)]
    names = ["label", "dim", "block", "cell", "task", "home", "rep", "size", "vector"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    got = Counter()
    for part in vector_dedup._tasks(iter(table.to_batches(max_chunksize=size)), 5):
        own = [r for r in part.to_pylist() if r["home"]]
        far = [r for r in part.to_pylist() if not r["home"]]
        assert len(far) <= 5 and len({r["cell"] for r in own + far}) == 1
        got.update((a["cell"], a["rep"], b["rep"]) for a in own for b in far)
    assert got == Counter((a[3], a[6], b[6]) for a in rows for b in rows if a[5] and not b[5] and a[3] == b[3])


def test_near_empty(spark, nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert simhash.near_groups(nothing).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_vectors(empty).count() == 0
