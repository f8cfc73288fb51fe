import hashlib
import os
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fitloom.llm import alignment
from fitloom.llm.subwords import Vocabulary, byte_letters

os.environ["TOKENIZERS_PARALLELISM"] = "false"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """Tokens of both libraries over the whole text: (A ids, B ids, group text, links) or None."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value = {c: k for k, c in enumerate(byte_letters())}

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    def one(text):
        if not text:
            return None
        ids, others = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [[bytes(value[c] for c in a.id_to_token(x)) for x in ids], [piece(x) for x in others]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] for p in parts] if len(ids) < 300 else [[], []]
        if not ends[0]:
            for e, p in zip(ends, parts):
                for x in p:
                    e.append((e[-1] if e else 0) + len(x))
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, low = [], [], [0, 0]
        for end in both:
            high = [e.index(end, l) + 1 for e, l in zip(ends, low)]
            own = [list(range(l, h)) for l, h in zip(low, high)]
            groups.append(",".join(str(ids[i]) for i in own[0]) + "|" + ",".join(str(others[j]) for j in own[1]))
            links += [(ids[i], others[j]) for i in own[0] for j in own[1]
                      if ends[0][i] - len(parts[0][i]) < ends[1][j] and ends[1][j] - len(parts[1][j]) < ends[0][i]]
            low = high
        return ids, others, ";".join(groups), links

    return one


@pytest.fixture(scope="module")
def some():
    rnd = random.Random(2)
    letters = list("abcXYZé Éà 019²½ !?.,''\"<|>_\n\n\t  İñ你🙂\x1c\x85\xa0 ́　 Ġ\x00") + ["<|endoftext|>", "<s>", "<0x0A>", "'ll", "  ", " \n ", "the ", "voilà dit"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(3000)] + [
        " ", "  ", "a ", " a", "a  ", "▁", "a ▁b", "\n \n  x", "x" * 3000, "日本" * 300, "à  b", "\x85 c", "　 c"]


@pytest.mark.parametrize("most, chained", [(200_000, True), (50, True), (200_000, False)])
def test_texts_align_as_with_the_libraries(library, some, most, chained):
    with open(A) as f, open(B, "rb") as g:
        aligner = alignment.Aligner(Vocabulary(f.read()), g.read(), most)
    assert aligner.chained
    aligner.chained = chained
    for at in range(0, len(some), 500):
        texts = some[at:at + 500]
        found, groups = aligner.align(pa.array(texts, pa.string()))
        for text, got, shown in zip(texts, found.to_pylist(), groups):
            want = library(text)
            if want is None:
                assert shown is None and not got["pairs"] and (got["n_a"], got["n_b"], got["n_groups"]) == (0, 0, 0), text
                continue
            ids, others, groups, links = want
            assert (got["n_a"], got["n_b"], got["n_groups"], shown) == (len(ids), len(others), groups.count(";") + 1, groups.encode()), text
            assert dict(zip(got["pairs"], got["times"])) == Counter(x << alignment.B_BITS | y for x, y in links), text


@pytest.mark.parametrize("frequent, parts", [(alignment.FREQUENT, alignment.PARTS), (200, 3)])
def test_alignment_measures(docs, library, frequent, parts):
    # one text holds a third of the rows
    hot = docs.limit(1).select("doc_id", F.lit("Over the hot 日 river").alias("text")).withColumn("doc_id", F.explode(F.sequence(F.lit(900), F.lit(940))))
    every = docs.unionByName(hot, allowMissingColumns=True).withColumn("pair", F.lit("x")).withColumn("copies", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in every.collect()]
    known = {t: library(t) for _, t in rows}
    counts, most = Counter(), defaultdict(int)
    for _, t in rows:
        counts.update(set(known[t][3]) if known[t] else [])
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter()
    for i, t in rows:
        if known[t] is None:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        ids, others, groups, links = known[t]
        want[(i, len(ids), len(others), groups.count(";") + 1, len(links), sum(counts[x] == most[x[0]] for x in links),
              sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest())] += 1
    got = alignment.alignment_measures(every, A, B, frequent, parts)
    assert Counter(map(tuple, got.collect())) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_aligned_texts_give_groups(docs, library):
    got = alignment.aligned_texts(docs, A, B, with_groups=True).collect()
    assert len(got) == len({r.text for r in docs.collect() if r.text})
    for r in got:
        want = library(r.text)
        assert r["groups"] == (want[2] if want else "") and r.copies >= 1


def test_nothing_to_align(nothing):
    assert alignment.alignment_measures(nothing, A, B).count() == 0
    blank = nothing.sparkSession.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.alignment_measures(blank, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
