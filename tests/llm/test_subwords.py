import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fitloom.llm import lexicon, packing, subwords, token_counts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name, texts):
    rnd = random.Random(1)
    letters = list("abcXYZé ÉÈßöñ 019²½ !?.,''\"<|>_\n\n\t  İıſŉΣσя你🙂\x1c\x85\xa0 ́") + [
        "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  ", "xaaaaaaaaaaaaa"]
    latin = [c for c in letters if all(ord(x) < 0x180 and x not in "'<" for x in c)]
    some = ["".join(rnd.choice(own) for _ in range(rnd.randint(0, 40))) for own in (letters, latin) for _ in range(3000)]
    some += texts[:60] + texts[-16:] + ["a" * 300, "ab" * 700, "é" * 100, None]
    with open(public_tokenizers.path(name)) as f:
        encoder = subwords.Encoder(subwords.Vocabulary(f.read()), most=500)
    got = []
    for at in range(0, len(some), 700):
        ids, offsets = encoder.encode(pa.array(some[at:at + 700], pa.string()))
        got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == library(name, some)


def test_all_letters_below_u0180():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encoder = subwords.Encoder(subwords.Vocabulary(f.read()))
    some = [f"a{chr(c)}B {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x180)]
    ids, offsets = encoder.encode(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library("word_bpe_49k.json", some)


@pytest.mark.parametrize("name", FILES)
def test_transcode(docs, texts, name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    want = Counter()
    for ids in library(name, texts):
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want[len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = lexicon.transcode(docs, public_tokenizers.path(name), lexicon.digests, most=20).collect()
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    whole = lexicon.transcode(docs.filter("n < 30"), public_tokenizers.path(name)).collect()
    assert sorted(map(tuple, (r.ids for r in whole))) == sorted(map(tuple, library(name, texts[:30])))


def test_transducer_holds_its_words_only():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"t", b"stop", "über".encode(), b"x" * 60})
    ids, counts = np.arange(len(words) * 2), np.full(len(words), 2)
    machine = lexicon.Transducer(lexicon.Transducer.build(words, ids, counts))
    others = [b"", b"ta", b"tapsx", b"o", b"x" * 61, b"zz"]
    assert machine.find(words + others).tolist() == [*range(len(words)), *[-1] * len(others)]
    assert len(machine.final) < sum(map(len, words))


def test_empty_tables(nothing):
    path = public_tokenizers.path(FILES[0])
    assert lexicon.transcode(nothing, path).count() == 0
    assert packing.pack(nothing, path).count() == 0
    assert token_counts.length_histogram(token_counts.token_lengths(nothing, path)).count() == 0


def test_length_histogram(docs, texts):
    lengths = [len(i) for i in library(FILES[0], texts)]
    rows = token_counts.length_histogram(token_counts.token_lengths(docs, public_tokenizers.path(FILES[0]))).collect()
    assert len(rows) == len(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert abs(r.share_to - sum(x <= r.n_tokens for x in lengths) / len(lengths)) < 1e-12
        assert r.truncated == sum(min(x, r.n_tokens) for x in lengths)


def test_packing(docs, texts):
    rows = packing.pack(docs, public_tokenizers.path(FILES[0])).collect()
    ids = library(FILES[0], texts)
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in ids)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.LIMIT
    want = Counter()
    for i in ids:
        i = [*i, packing.END_ID]
        first = len(i) % 1024 or 1024
        cuts = [0, *range(first, len(i) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, a, b - a, packing.crc32(np.array(i[a:b], "<u4").tobytes())] += 1
    assert Counter(x for own in by_doc.values() for x in own) == want
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_the_histogram_up(seed):
    random_ = np.random.RandomState(seed)
    histogram = np.zeros(1025, np.int64)
    for x in random_.choice([3, 90, 400, 600, 1024, *range(1, 1025)], 5000, p=[0.2, 0.1, 0.1, 0.05, 0.05, *[0.5 / 1024] * 1024]):
        histogram[x] += 1
    used = np.zeros(1025, np.int64)
    sequences = 0
    for lengths, times in packing.fit_patterns(histogram, 1024):
        assert sum(lengths) <= 1024 and times > 0
        sequences += times
        for x in lengths:
            used[x] += times
    assert (used == histogram).all()
    assert sequences <= 1.02 * (np.arange(1025) @ histogram) / 1024 + 1
