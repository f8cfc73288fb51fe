import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from fitloom.llm import wide_simhash


def shingles(text, brute, size=5):
    words = brute.words(text)
    return {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def fingerprint(text, brute):
    out = []
    own = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, brute)]
    for w in range(wide_simhash.WORDS):
        mixed = [((h ^ h >> 29) * int(wide_simhash.MIX[w])) & (1 << 64) - 1 for h in own]
        mixed = [m ^ m >> 32 for m in mixed]
        out.append(sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed)))
    return out


def test_fingerprints_by_brute_force(texts, brute):
    some = [t for t in texts if len(t or "") < 3000]
    got = wide_simhash._prints([(t or "").encode() for t in some], 5)
    assert got.tolist() == [fingerprint(t, brute) for t in some]
    assert wide_simhash._prints([], 5).shape == (0, wide_simhash.WORDS)


def test_recall_by_similarity(brute):
    """Pairs of texts with random edits: which of them the bound and the grids bring together."""
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(20000)]
    pairs, similar = [], []
    for _ in range(1200):
        own = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 100, 200, 400]))]
        other, least = list(own), rnd.uniform(0.4, 1)
        while True:
            other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            a, b = (shingles(" ".join(x), brute) for x in (own, other))
            if len(a & b) / len(a | b) < least:
                break
        pairs += [" ".join(own).encode(), " ".join(other).encode()]
        similar.append(len(a & b) / len(a | b))
    prints = wide_simhash._prints(pairs, 5)
    a, b, j = prints[::2], prints[1::2], np.array(similar)
    ea, eb = wide_simhash._embedded(a), wide_simhash._embedded(b)
    met = np.zeros(len(j), bool)
    for w, mask in wide_simhash.grids(10**6):
        met |= (ea[:, w] ^ eb[:, w]) & np.uint64(mask & (1 << 64) - 1) == 0
    found = met & (np.bitwise_count(a ^ b).sum(1) <= wide_simhash.most_bits())
    share = lambda low, high: found[(j >= low) & (j < high)].mean()
    assert share(0.8, 1.01) >= 0.9 and share(0.85, 0.9) >= 0.93 and share(0.9, 1.01) >= 0.98
    assert share(0.6, 0.7) <= 0.15 and share(0.4, 0.6) <= 0.01


def test_grids_follow_the_table():
    small, large = wide_simhash.grids(10), wide_simhash.grids(10**9)
    assert len(small) < len(large) and all(bin(m & (1 << 64) - 1).count("1") == 16 for _, m in small)
    assert all(bin(m & (1 << 64) - 1).count("1") > 24 for _, m in large)


@pytest.mark.parametrize("heavy, few", [(4096, 16), (20, 4)])
def test_links_connect_what_brute_force_does(spark, brute, monkeypatch, heavy, few):
    monkeypatch.setattr(wide_simhash, "HEAVY", heavy)
    monkeypatch.setattr(wide_simhash, "HALF", heavy // 2)
    monkeypatch.setattr(wide_simhash, "FEW", few)
    random_ = np.random.RandomState(heavy)
    rows = []
    for c in range(30):
        centre = random_.randint(0, 2, 256)
        for _ in range(40 if c % 5 == 0 else 2):
            flipped = centre.copy()
            flipped[random_.choice(256, random_.randint(0, 30), replace=False)] ^= 1
            rows.append(np.packbits(flipped, bitorder="little").view("<u8"))
    prints = np.unique(np.array(rows, np.uint64), axis=0)
    bits = np.bitwise_count(prints[:, None] ^ prints).sum(-1)
    want = brute.roots(len(prints), np.argwhere(np.triu(bits <= wide_simhash.most_bits(), 1)).tolist())
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(prints.view(np.int64).tolist())], "node long, p0 long, p1 long, p2 long, p3 long")
    found = wide_simhash.near_links(df, len(prints), missed=1e-9).collect()
    assert brute.roots(len(prints), [(r.a, r.b) for r in found]) == want
    assert all(bits[r.a, r.b] <= 10 * wide_simhash.most_bits() for r in found)


def test_near_copies(docs, nothing, brute):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = wide_simhash._prints([(t or "").encode() for _, t in rows], 5)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]).sum(1) <= wide_simhash.most_bits()) if j > i]
    roots, least = brute.roots(len(rows), links), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, brute.BIG), brute.BIG if i is None else i)
    got = wide_simhash.near_copies(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, None if least[r] == brute.BIG else least[r]) for (i, _), r in zip(rows, roots))
    assert sum(r.kept for r in got) == len(set(roots))
    assert wide_simhash.near_copies(nothing).count() == 0
