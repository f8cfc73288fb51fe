import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fitloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def windows(text, size=10):
    words = WORD.findall(folded(text))
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def expected(text, items):
    found = list(WORD.finditer(folded(text)))
    words = [m[0] for m in found]
    hit, ids = set(), set()
    for size in {len(w) for _, own in items for w in own}:
        of = defaultdict(set)
        for item, own in items:
            for w in own:
                of[w].add(item)
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in of:
                hit |= set(range(i, i + size))
                ids |= {str(x) for x in of[tuple(words[i:i + size])] if x is not None}
    spans = []
    for i in sorted(hit):
        if i - 1 in hit:
            spans[-1] = (spans[-1][0], found[i].end())
        else:
            spans.append((found[i].start(), found[i].end()))
    return len(words), len(hit), tuple(sorted(ids)), tuple(spans)


@pytest.fixture(scope="module")
def bench(texts):
    rnd = random.Random(3)
    rows = [(k, texts[k][:300]) for k in range(0, 40, 3)] + [(100, "A b C"), (101, "日本語"), (102, "The, the."), (103, ""), (104, None), (105, " -- "), (106, "seven"), (None, texts[22])]
    words = [rnd.choice(texts[0].split() or ["x"]) for _ in range(4)]
    return rows + [(107, " ".join(words)), (100, "A b C"), (100, "12 34"), (9, "ünter über É grün Stein")]


@pytest.fixture(scope="module")
def hidden(docs, texts, bench):
    """The documents of all kinds, and some that hold passages of items in other dress."""
    spark = docs.sparkSession
    marked = [(500 + k, "ÄÖ 🙂 " + (t or "").upper().replace(" ", " -\n") + "; é end", "en", 0) for k, (_, t) in enumerate(bench)]
    extra = spark.createDataFrame(marked, "doc_id long, text string, lang string, n int")
    return docs.select("doc_id", "text", "lang", "n").union(extra).withColumn("items", F.lit("x")).withColumn("starts", F.lit(1)).withColumn("share", F.lit(1))


@pytest.mark.parametrize("pairs", [1 << 18, 40])
def test_contaminated_words(hidden, bench, pairs):
    spark = hidden.sparkSession
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("window", F.lit("y")).withColumn("words", F.lit(1))
    own = [(i, windows(t)) for i, t in bench]
    rows = hidden.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *expected(r.text, own)) for r in rows)
    got = decontaminate.contaminated_words(hidden, items, pairs=pairs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans)) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    assert sum(r.n_hit > 0 for r in got) > 20


def test_several_automata_take_several_scans(spark, bench):
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate.item_windows(items).count() > 4 * 40


def test_decontaminated_keeps_columns_and_clean_rows(hidden, bench):
    items = hidden.sparkSession.createDataFrame(bench, "item_id long, text string")
    own = [(i, windows(t)) for i, t in bench]
    kept = decontaminate.decontaminated(hidden, items)
    assert kept.columns == hidden.columns
    clean = Counter(r.text for r in hidden.collect() if not expected(r.text, own)[1])
    assert Counter(r.text for r in kept.collect()) == clean
    assert decontaminate.decontaminated(hidden, items, most=1.0).count() == hidden.count()


def test_nothing_to_find(hidden, nothing, bench):
    items = hidden.sparkSession.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminated_words(hidden, items.filter("item_id > 1000")).collect()
    assert len(found) == hidden.count() and not any(r.contaminated or r["items"] or r.spans for r in found)
    assert decontaminate.contaminated_words(nothing, items).count() == 0
