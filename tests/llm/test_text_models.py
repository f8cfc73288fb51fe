import glob
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fitloom.llm import attention, chat, language, licenses, lm_scoring, wide_simhash


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def test_licenses(spark, docs):
    some = ["Apache License MIT license cc by cc by, CC BY nc", "apacheKLicense gnu general public licence", "cc-by", "cc by " * 500,
            "Licensed under the Apache Licence, Version 2.0", "this program is free software; you can now redistribute it and/or modify it "
            "under the terms of the GNU General Public License", None, "", "the apache", "license mit", "Permission is hereby granted to any person"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + k, t) for k, t in enumerate(some)], "doc_id long, text string"))
    want = Counter()
    for r in df.collect():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        want[r.doc_id, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None),
             ",".join(sorted({x for _, x in at}))] += 1
    got = licenses.license_labels(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[9004][0] == "apache" and 0.8 > labels[9004][1] or labels[9004] == ("", 0.0)
    assert labels[9005] == ("gpl", 1.0) and labels[9002] == ("cc-by", 1.0) and labels[9010] == ("", 0.0)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    plan = licenses.license_labels(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_an_inserted_word_moves_the_diagonal(spark):
    text = "permission is hereby granted free of any charge to any person obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, f"intro {text} end")], "doc_id long, text string")
    spans = licenses.scan(df).filter("template >= 0").collect()
    assert [(r.label, r.start, r.stop) for r in spans] == [("mit", 1, 1 + len(text.split()))] and spans[0].covered > 0.9


def test_whole_licence_texts_are_templates(spark):
    """Texts of any length, from the licences that installed packages bring along."""
    found = {}
    for path in sorted(glob.glob(f"{os.path.dirname(os.path.dirname(np.__file__))}/*.dist-info/**/*", recursive=True)):
        if re.search(r"/(licen[cs]e|copying)[^/]*$", path, re.I) and os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), f.read()))
            if 150 < len(words) < 12000:
                found.setdefault(tuple(words[:60]), words)
    texts = list(found.values())[:5]
    if len(texts) < 3:
        pytest.skip("no licence texts are installed")
    notices = [(" ".join(w), f"text{k}") for k, w in enumerate(texts)]
    rnd = random.Random(1)
    rows = []
    for k, w in enumerate(texts):
        cut = len(w) // 2
        rows += [(3 * k, "before " * 70 + " ".join(w) + " after"), (3 * k + 1, " ".join([*w[:cut], "inserted", *w[cut:]])),
                 (3 * k + 2, " ".join(rnd.sample(w, len(w))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.license_labels(df, phrases=[], notices=notices).collect()}
    for k in range(len(texts)):
        assert got[3 * k].labels.split(",").count(f"text{k}") == 1 and got[3 * k].score == 1.0
        assert f"text{k}" in got[3 * k + 1].labels.split(",") and got[3 * k + 1].score > 0.99
        assert got[3 * k + 2].labels == ""
    spans = licenses.scan(df.filter("doc_id = 0"), phrases=[], notices=notices).filter("template >= 0 and exact").collect()
    assert [(r.template, r.start, r.stop) for r in spans] == [(0, 70, 70 + len(texts[0]))]


def test_licences_of_nothing_and_clashing_columns(docs, nothing):
    assert licenses.license_labels(nothing).count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("template"), F.lit(1).alias("place"), F.lit(1).alias("at"), F.lit(1).alias("gram"))
    assert Counter(map(tuple, licenses.license_labels(clash).collect())) == Counter(map(tuple, licenses.license_labels(docs).collect()))


def test_unigram_base_and_scores(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [(i, fold(i) == 1, [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    counts = Counter(w for _, held, own in words if not held for w in own)
    n, v = sum(counts.values()), len(counts)
    base = lambda own: round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 4)
    want = sorted((str(i), held, len(own), sum(counts[w] > 0 for w in own), n, base(own)) for i, held, own in words)
    out = lm_scoring.scores(docs, public_tokenizers.path("word_bpe_49k.json"), frequent=30, every=4).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-3 for a, b in zip(got, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    prose = [r for r in out if r.held_out and 40 < r.n_tokens < 300]
    assert sum(r.score for r in prose) / sum(r.n_tokens for r in prose) > -3


def test_scores_of_nothing(nothing):
    assert lm_scoring.scores(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_share_of_training_windows():
    assert lm_scoring.EVERY <= 16


def test_every_training_token_reaches_the_model(spark, docs):
    from fitloom.llm.subwords import broadcast_vocabulary
    vocab = broadcast_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    blocks = lm_scoring.gather(docs, vocab).filter("ids is not null").select("start", "turn", "ids").toArrow()
    parts = [lm_scoring.training_windows(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)) for b in blocks.to_batches()]
    subwords = lm_scoring.Subwords(vocab.value)
    want = Counter()
    for r in docs.collect():
        if fold(r.doc_id) != 1:
            places, per_row, words = lm_scoring.ascii_words(pa.array([r.text]))
            ids, offsets = subwords.of(places, per_row, words.to_pylist())
            # what a token may look at is the same as when it is scored
            text, first = attention.windows(np.diff(offsets))
            inputs, open_, targets, counted = attention.window_ids(ids, offsets, text, first)
            for i, o, t, c in zip(inputs, open_, targets, counted):
                want[tuple(i[o]), tuple(t[c])] += 1
    got = Counter((tuple(i[o]), tuple(t[c])) for part in parts for i, o, t, c in zip(*part))
    assert got == want


def test_every_token_is_scored_once_and_only_from_the_left():
    random = np.random.RandomState(1)
    lengths = np.array([1, 16, 17, 50, 3])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    ids = random.randint(0, 200, offsets[-1])
    tables = attention.Tables(np.bincount(ids, minlength=200).astype(float), random.rand(200, attention.BUCKETS))
    text, first = attention.windows(lengths)
    *_, targets, counted = attention.window_ids(ids, offsets, text, first)
    assert targets[counted].tolist() == ids.tolist()
    model = attention.Model.fresh(tables.prior)
    whole = lm_scoring.text_scores(ids, offsets, model, tables)
    assert np.allclose(whole, lm_scoring.text_scores(ids, offsets, model, tables, block=2), rtol=1e-4)
    # one token after the first 20 in all ways sums to one, whatever comes later
    total = 0.0
    start = lm_scoring.text_scores(ids[34:54], np.array([0, 20]), model, tables)[0]
    every = np.concatenate([np.append(ids[34:54], k) for k in range(200)])
    total = np.exp(lm_scoring.text_scores(every, np.arange(201) * 21, model, tables) - start).sum()
    assert abs(total - 1) < 1e-3


def test_gradient():
    random = np.random.RandomState(0)
    model = attention.Model.fresh(np.zeros(attention.CLASSES))
    rows, open_ = random.randint(0, attention.ROWS, (3, attention.SPAN)), np.ones((3, attention.SPAN), bool)
    open_[0, :10] = False
    targets, counted = random.randint(0, attention.CLASSES, (3, attention.STEP)), np.ones((3, attention.STEP), np.float32)
    counted[1, 10:] = 0
    loss = lambda flat: -(attention.Model(flat).class_scores(rows, open_, targets) * counted).sum() / counted.sum()
    g = model.gradient(rows, open_, targets, counted)
    for i in [*random.randint(attention.ROWS * attention.WIDTH, len(g), 30).tolist(), int(rows[2, 20]) * attention.WIDTH]:
        high, low = model.flat.copy(), model.flat.copy()
        high[i] += 0.03
        low[i] -= 0.03
        assert abs((loss(high) - loss(low)) / 0.06 - g[i]) < 1e-4


def test_scoring_and_training_steps_in_place():
    """Same results as the plain formulas; a block of scored windows stays within a core's cache."""
    random = np.random.RandomState(3)
    lengths = np.full(40, 161)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    ids = random.randint(0, 200, offsets[-1])
    tables = attention.Tables(np.bincount(ids, minlength=200).astype(float), random.rand(200, attention.BUCKETS))
    model = attention.Model.fresh(tables.prior)
    text, first = attention.windows(lengths)
    inputs, open_, targets, counted = attention.window_ids(ids, offsets, text, first)
    parts = (np.where(inputs < 0, tables.begin, tables.row_of[np.maximum(inputs, 0)]).astype(np.int16), open_,
             tables.class_of[targets].astype(np.int16), counted.astype(np.float32))
    batches = [tuple(x[at:at + 64] for x in parts) for at in range(0, len(text), 64)]
    flat, mean, square = model.flat.astype(float), 0.0, 0.0
    for step, batch in enumerate(batches, 1):
        g = attention.Model(flat).gradient(*batch).astype(float)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        flat = flat - 0.01 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
    trained = attention.train(model, iter(batches))
    assert np.abs(trained.flat - flat).max() < 1e-3
    tracemalloc.start()
    whole = lm_scoring.text_scores(ids, offsets, trained, tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(whole, lm_scoring.text_scores(ids, offsets, trained, tables, block=1000), rtol=1e-4)
    assert peak < 2 << 20


def test_blocks_of_stored_ids_are_scored_like_whole_texts(spark):
    """Texts are encoded once, for training and scores: held-out ones have blocks too, but no counts."""
    from fitloom.llm.subwords import broadcast_vocabulary
    vocab = broadcast_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["one", "Two", "three", "x"], k=k)) for k in (0, 3, 511, 512, 513, 1500, 16, 17)] * 2
    frame = lm_scoring.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    rows = {r.row: r for r in frame.collect()}
    got = lm_scoring.encoded(frame, vocab).toArrow()
    counts = Counter()
    for r in got.filter(pa.compute.is_valid(got["word"])).select(["word", "n"]).to_pylist():
        counts[r["word"]] += r["n"]
    training = [r.text for r in rows.values() if not r.held_out]
    assert 0 < len(training) < len(texts)
    assert counts == Counter(w.lower().encode() for t in training for w in t.split()) + Counter({b"": len(training)})
    blocks = got.filter(pa.compute.is_valid(got["ids"])).select(["row", "held_out", "start", "ids"]).combine_chunks()
    assert len(blocks) > len(texts) and all(rows[r["row"]].held_out == r["held_out"] for r in blocks.to_pylist())
    subwords, size = lm_scoring.Subwords(vocab.value), len(vocab.value.tokens)
    state = np.random.RandomState(2)
    tables = attention.Tables(state.randint(0, 9, size).astype(float), state.rand(size, attention.BUCKETS))
    model = attention.Model.fresh(tables.prior)
    lists = blocks["ids"].chunk(0)
    offsets = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())))
    score = lm_scoring.text_scores(lists.flatten().to_numpy(), offsets, model, tables, start=blocks["start"].to_numpy())
    total = Counter()
    for row, x in zip(blocks["row"].to_pylist(), score):
        total[row] += x
    assert total.keys() == rows.keys()
    for row, r in rows.items():
        places, per_row, words = lm_scoring.ascii_words(pa.array([r.text]))
        whole = lm_scoring.text_scores(*subwords.of(places, per_row, words.to_pylist()), model, tables)[0]
        assert abs(total[row] - whole) < 1e-4 * abs(whole)


def test_scores_of_rows_in_another_order_each_time(spark):
    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.RandomState().permutation(batch.num_rows)))

    rows = [(i, "alpha " * (60 * i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).mapInArrow(shuffled, "doc_id long, text string")
    got = sorted(lm_scoring.scores(docs, public_tokenizers.path("word_bpe_49k.json")).collect())
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, 60 * i + 1) for i in range(40)]
    assert all(a.score > b.score for a, b in zip(got, got[1:]))


def test_suffix_automaton():
    words = ["abab", "babb", "a", "bbbbb", "abcabx"]
    arcs = language.suffix_automaton(words)
    got, stack = set(), [(0, "")]
    while stack:
        state, text = stack.pop()
        for c, to in arcs[state].items():
            got.add(text + c)
            stack.append((to, text + c))
    assert got == {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}


def test_phrases_by_brute_force():
    sample = {"a": ["rain river stone", "rain house"], "b": ["haus fluss stein", "haus regen"]}
    parser = language.Parser(sample)
    words = ["rain", "haus", "xq", "stones", "r", "fluhaus", "日"]
    for k, name in enumerate(parser.languages):
        known = [f" {w} " for t in sample[name] for w in t.split()]
        for w, got in zip(words, parser.phrases(words)[:, k].tolist()):
            rest, n = f" {w} ", 0
            while rest:
                size = max((m for m in range(1, len(rest) + 1) if any(rest[:m] in x for x in known)), default=1)
                rest, n = rest[size:], n + 1
            assert got == n, (name, w)


def test_language(docs):
    out = language.predictions(docs).collect()
    rows = {(r.doc_id, r.text): r.lang for r in docs.collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in out)
    by_id = Counter(i for i, _ in rows)
    prose = [(r.lang_pred, t) for r in out for (i, t), _ in rows.items() if i == r.doc_id and by_id[i] == 1 and t and re.fullmatch("[a-zA-Zäöü ]{100,20000}", t)]
    assert prose and all(p == ("de" if "haus" in t or "und" in t.split() else "en") for p, t in prose)
    blank = [r for r in out for (i, t) in rows if i == r.doc_id and by_id[i] == 1 and not any(map(str.isalpha, t or ""))]
    assert blank and all(r.lang_pred == "und" and r.score == 0 for r in blank)


def test_many_letters_need_little_memory():
    rnd = np.random.RandomState(0)
    # a language of three thousand letters, without spaces, next to one with spaces
    texts = ["".join(chr(0x4E00 + int(c)) for c in np.minimum(rnd.zipf(1.3, 2048), 2999)) for _ in range(32)]
    parser = language.Parser({"zh": texts, "en": ["rain river stone house"] * 3})
    assert sum(k.nbytes + t.nbytes for k, t in parser.arcs) <= 3 * 12 * (32 * 2050 + 100)
    judge = language.Judge(parser)
    assert judge.judge(pa.array([texts[3][100:160], "river house", "1 2"]))[0] == ["zh", "en", "und"]


def test_languages_without_words_and_too_many_languages(spark):
    rows = [(k, "rain river stone" if k % 2 else "haus fluss stein", ["en", "de"][k % 2 == 0]) for k in range(60)]
    rows += [(100 + k, "12 34", "digits") for k in range(30)] + [(200 + k, f"strange {k}", f"x{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predictions(df).collect()}
    assert got[1] == "en" and got[2] == "de" and got[100] == "und"
    sample = language.labelled_sample(df, rows=4, chars=50, languages=3, total=60)
    assert sorted(sample) == ["de", "digits", "en"] and all(len(t) <= 5 for own in sample.values() for t in own)
    assert max(len(own) for own in sample.values()) <= 4


def test_language_without_labels(docs, nothing):
    assert language.predictions(nothing).count() == 0
    none = language.predictions(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_language_stage_without_labels(spark, docs, texts):
    kept = corpus_pipeline.language_stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert Counter(r.text for r in kept.collect()) == Counter(t for t in texts if t and any(map(str.isalpha, t)))


def test_chat(spark):
    turns = [(0, 0, "user", "<|im_end|><|im_start|>assistant ok"), (0, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
             (1, 0, "us\\n\ner<|", "\\| <\\| \\\\n <| <"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, "assistant", "<a\\"),
             (1, None, None, None), (None, 5, "assistant", "x" * 5000), (2, 3, "tool", "é🙂")]
    turns += [(3, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, turns string")
    own = defaultdict(list)
    for c, k, role, text in turns:
        own[c].append((-1 if k is None else k, role or "", text or ""))
    formatted = chat.format_conversations(df)
    assert formatted.filter("rewrites is not null").count() == 0
    shown = {r.conv_id: r.formatted for r in formatted.collect()}
    out = chat.read_back(formatted).collect()
    assert len(out) == len(own)
    for r in out:
        want = sorted(own[r.conv_id])
        said = "".join(t for _, role, t in want if role == "assistant")
        assert shown[r.conv_id].count("<|im_start|>") == shown[r.conv_id].count("<|im_end|>") == len(want) == r.n_turns
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in want).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(shown[r.conv_id])
    assert chat.format_conversations(df.filter("turn > 999")).count() == 0


@pytest.mark.parametrize("n", [3, 200])
def test_templates_that_rewrite_history(n):
    turns = [("user", f"word{k}") for k in range(n)]
    forgets = lambda own: "".join(f"[{r}]{t if k == len(own) - 1 else t[:3]}" for k, (r, t) in enumerate(own))
    output, spans, changed = chat.locate(forgets, turns)
    assert changed == 1 and output == forgets(turns) and len(spans) == 1
    late = lambda own: ("late" if len(own) > n - 1 else "early") + "".join(t for _, t in own)
    assert chat.locate(late, turns)[2] == n - 1
    numbered = lambda own: "".join(f"{k}:{t}\n" for k, (_, t) in enumerate(own))
    output, spans, changed = chat.locate(numbered, turns)
    assert changed is None and [output[a:b] for *_, a, b in spans] == [t for _, t in turns]


def test_a_rewrite_that_is_undone_later():
    turns = [("user", f"word{k}") for k in range(150)]
    sums_up = lambda own: "sum" if len(own) == 100 else "".join(t for _, t in own)
    assert chat.locate(sums_up, turns)[2] == 99


@pytest.mark.parametrize("block", [512, 7])
def test_long_conversations_are_rendered_in_blocks(spark, block):
    rows = [(c, k, "user" if k % 3 else "assistant", f"t{k}") for c, n in ((1, 150), (2, 6), (3, 7), (4, 8), (None, 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    sums_up = lambda own: "sum" if len(own) == 100 else "".join(f"<{r}>{t};" for r, t in own)
    got = {r.conv_id: r for r in chat.format_conversations(df, sums_up, block=block).collect()}
    assert sorted(got, key=str) == [1, 2, 3, 4, None]
    for c, r in got.items():
        own = [(x[2], x[3]) for x in rows if x[0] == c]
        assert r.formatted == sums_up(own) and r.n_turns == len(own)
        assert r.rewrites == (99 if c == 1 else None)
        said = [t for k, (role, t) in enumerate(own) if role == "assistant" and (c != 1 or k < 99)]
        assert [r.formatted[x.start:x.end] for x in r.loss] == said


def test_pipeline_stages(spark, docs, texts, tmp_path, brute):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lettered = [t for t in texts if t and any(map(str.isalpha, t))]
    sizes = [len(lettered), len({brute.normalised(t) for t in lettered})]
    for (name, stage), size in zip(corpus_pipeline.STAGES[:2], sizes):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        given = spark.read.parquet(f"{tmp_path}/{name}")
        assert given.columns == docs.columns and given.count() == size
    near = corpus_pipeline.STAGES[2][1](spark, given, str(tmp_path))
    assert near.columns == docs.columns
    rows = [r.text for r in given.collect()]
    prints = wide_simhash._prints([t.encode() for t in rows], 5)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]).sum(1) <= wide_simhash.most_bits())]
    assert near.count() == len(set(brute.roots(len(rows), links)))
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.filter("piece = 0").count() == near.count()


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_most_frequent(spark):
    from fitloom.llm.common import most_frequent
    counts = spark.createDataFrame([(f"w{k}", k // 3 + 1) for k in range(300)] + [("top", 10**12)], "word string, n long")
    for most in (0, 1, 2, 50, 300, 301, 999):
        rows = most_frequent(counts, most).collect()
        assert len(rows) <= most
        rest = {r.word for r in counts.collect()} - {r.word for r in rows}
        if rows:
            assert min(r.n for r in rows) > max([r.n for r in counts.collect() if r.word in rest], default=0)
    assert most_frequent(counts, 301).count() == 301 and most_frequent(counts.filter("n < 0"), 5).count() == 0
