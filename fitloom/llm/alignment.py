"""Cross-tokenizer alignment of exactly deduplicated texts.

Equal texts meet in a shuffle by the full text. Each distinct one is encoded by a byte-level tokenizer
(A) and a piece model (B) and aligned once: where tokens of both end, a group ends; tokens whose bytes
overlap are linked. Pairs of linked ids are counted over all documents, a text's copies as its weight,
and the measures go back to every doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Shipped, most_frequent, pieces, ragged, stored, text_buffer
from fitloom.llm.subwords import Encoder, Splitter, Vocabulary, byte_letters
from fitloom.plans.skew import PARTS, join_by_weight

# A pair of ids is one number: A's id above, B's in the lowest bits.
B_BITS = 20
PAIR = 1 << 2 * B_BITS
# Pairs that are looked up in memory: some 8 MB for each executor. Others meet their counts in a join.
FREQUENT = 1 << 18
# Bytes of texts that are aligned at a time, and words that tokenizer A remembers.
BYTES, WORDS = 2 << 20, 100_000

# The space before which a text can be cut: one after a character that is no white space. These end
# the UTF-8 forms of all white space that is not ASCII; after a two-byte letter they are harmless.
BLANK_TAILS = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
BLANK_ASCII = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments start: at every text, and at spaces after what is surely no white space."""
    start = np.zeros(len(raw), bool)
    at = np.flatnonzero(raw == 32)
    at = at[at > 0]
    before = raw[at - 1]
    lead = raw[np.maximum(at - 2, 0)]
    start[at] = ~BLANK_ASCII[before] & (~BLANK_TAILS[before] | (lead >= 0xC3) & (lead <= 0xDF))
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


class Strings:
    """Byte strings by number, to be laid out one after the other."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def of(self, numbers: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        parts = (numbers[k:k + step] for k in range(0, len(numbers), step))
        return np.concatenate([np.empty(0, np.uint8), *(self.data[ragged(self.starts[x], self.sizes[x])] for x in parts)])


class Aligner:
    """Aligns texts, each with a space before it, many at a time.

    The piece model never joins what stands before a space with the space, so it encodes the distinct
    segments between spaces. With a model for which that doesn't hold, a whole text is a segment.
    """

    def __init__(self, vocab: Vocabulary, model: bytes, most: int = WORDS):
        value = {c: k for k, c in enumerate(byte_letters())}
        self.first = Encoder(vocab, most=most)
        self.first.splitter = Splitter(folded=False)  # strings of special tokens are plain text
        self.a_bytes = Strings([bytes(value[c] for c in t) for t in vocab.tokens])
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.b_bytes = Strings([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)])
        self.digits = Strings([b"%d," % k for k in range(max(len(vocab.tokens), len(names)))])
        self.chained = self.model.normalize("  a  b ") == "▁▁▁a▁▁b▁" and not any("▁" in p.lstrip("▁") for p in names)
        self.blank = names.index("▁") if "▁" in names else -1

    def _segments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """B's ids of all texts, how many each text has, and which texts they give back."""
        at = boundaries(raw, offsets) if self.chained else offsets[:-1]
        ends = np.append(at, len(raw)).astype(np.int64)
        coded = pa.Array.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        tokens = self.model.encode([n[1:].decode("utf-8", "replace") for n in names], num_threads=1)
        if self.chained:
            tokens = [[self.blank] if n == b" " else own for n, own in zip(names, tokens)]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.cumsum(counts) - counts
        ids = np.fromiter(chain.from_iterable(tokens), np.int64, int(counts.sum()))
        # a segment is good if its tokens have its bytes
        total = np.concatenate(([0], np.cumsum(self.b_bytes.sizes[ids])))
        long = np.fromiter(map(len, names), np.int64, len(names))
        good = total[starts + counts] - total[starts] == long
        kept = ids[np.repeat(good, counts)]
        same = self.b_bytes.of(kept) == np.frombuffer(b"".join([n for n, ok in zip(names, good.tolist()) if ok]), np.uint8)
        wrong = np.concatenate(([0], np.cumsum(~same)))
        edge = np.concatenate(([0], np.cumsum(long[good])))
        good[np.flatnonzero(good)] = wrong[edge[1:]] == wrong[edge[:-1]]
        places = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(at, offsets)
        each = counts[places]
        sums = np.concatenate(([0], np.cumsum(each)))
        bad = np.concatenate(([0], np.cumsum(~good[places])))
        return ids[ragged(starts[places], each)], np.diff(sums[bounds]), bad[bounds[1:]] == bad[bounds[:-1]]

    def align(self, column: pa.Array) -> tuple[pa.RecordBatch, list[bytes | None]]:
        """n_a, n_b, n_groups, pairs and times of every text, and the text of its groups (None without tokens)."""
        raw, offsets = text_buffer(column)
        raw = np.insert(raw, offsets[:-1], 32)
        offsets = offsets + np.arange(len(offsets))
        n = len(offsets) - 1
        spaced = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        a, a_offsets = self.first.encode(spaced)
        a = a.astype(np.int64)
        b, b_counts, good = self._segments(raw, offsets)
        a_counts = np.diff(a_offsets)
        # byte-level tokens have the bytes of their text whatever it is; lengths would tell otherwise
        sums = np.concatenate(([0], np.cumsum(self.a_bytes.sizes[a])))
        good = good & (sums[a_offsets[1:]] - sums[a_offsets[:-1]] == np.diff(offsets))
        a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
        a_counts, b_counts, sizes = a_counts * good, b_counts * good, np.diff(offsets) * good
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        limits = np.cumsum(sizes)
        # between two neighbouring ends of either side lies one link
        every = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        twice = every[1:] == every[:-1]
        ends = every[np.concatenate(([True], ~twice))[:len(every)]]
        owner = np.searchsorted(limits, ends)
        pair = a[np.searchsorted(a_ends, ends)] << B_BITS | b[np.searchsorted(b_ends, ends)]
        seen, times = np.unique(owner * PAIR + pair, return_counts=True)
        rows = pa.array(np.searchsorted(seen, np.arange(n + 1) * PAIR).astype(np.int32))
        cuts = every[1:][twice]
        n_groups = np.bincount(np.searchsorted(limits, cuts), minlength=n)
        found = pa.RecordBatch.from_arrays(
            [pa.array(a_counts), pa.array(b_counts), pa.array(n_groups.astype(np.int64)),
             pa.ListArray.from_arrays(rows, pa.array(seen % PAIR)), pa.ListArray.from_arrays(rows, pa.array(times.astype(np.int64)))],
            ["n_a", "n_b", "n_groups", "pairs", "times"])
        return found, self._groups(a, b, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), a_counts + b_counts, good)

    def _groups(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, counts: np.ndarray, good: np.ndarray) -> list[bytes | None]:
        """``a1,a2|b1;a3|b2,b3`` of every text: of each group first A's tokens, then B's."""
        side = np.concatenate((a_group * 2, b_group * 2 + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((a, b))[order]
        shown = self.digits.of(ids)
        at = np.cumsum(self.digits.sizes[ids]) - 1
        last = np.concatenate((side[1:] != side[:-1], [True]))[:len(side)]
        shown[at[last]] = np.where(side[last] % 2, ord(";"), ord("|"))
        stops = np.concatenate(([0], at + 1))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        whole = memoryview(shown)
        return [bytes(whole[s:e - 1]) if ok else None for s, e, ok in zip(stops, stops[1:], good.tolist())]


def aligned_texts(docs: DataFrame, tokenizer: str, model: str, with_groups: bool = False) -> DataFrame:
    """One row per distinct text of ``docs`` that is not null or empty.

    text_key (SHA-256, binary); copies; n_a, n_b, n_groups; groups_sha256; pairs, times: the linked pairs
    of ids (`B_BITS`) and how often each occurs. With ``with_groups`` also text and groups, written as
    ``a1,a2|b1;a3|b2,b3``. A text that one of the tokenizers doesn't give back byte by byte has no
    tokens: zeros, empty lists, '' for the digest.
    """
    with open(tokenizer, encoding="utf-8") as f, open(model, "rb") as g:
        sent = Shipped(docs.sparkSession, (Vocabulary(f.read()), g.read()))
    extra = ["text", "groups"] if with_groups else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sent.value)
        for batch in batches:
            for piece in pieces(batch, "text", BYTES):
                found, groups = aligner.align(piece.column(2))
                digests = ["" if g is None else hashlib.sha256(g).hexdigest() for g in groups]
                shown = [piece.column(2), pa.array([(g or b"").decode() for g in groups])] if with_groups else []
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:2], *found.columns[:3], pa.array(digests, pa.string()), *found.columns[3:], *shown],
                    ["text_key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", *extra])

    distinct = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.select(F.unhex(F.sha2("text", 256)).alias("text_key"), "copies", "text").mapInArrow(
        run, "text_key binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
        + (", text string, groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best for every pair of linked ids: n documents hold it; best: none of the same A id has more."""
    counts = stored(aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n")))
    a = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """text_key, n_links, n_best, count_sum of every aligned text with tokens.

    The most frequent pairs are looked up in a broadcast table of at most ``frequent`` rows; only the
    links of rarer pairs are shuffled.
    """
    links = aligned.select("text_key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "text_key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = links.join(F.broadcast(most_frequent(counts, frequent)), "pair", "left")
    rare = known.filter("n is null").select("text_key", "pair", "times").join(counts, "pair")
    sums = [F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = [x.groupBy("text_key").agg(*sums) for x in (known.filter("n is not null"), rare)]
    return parts[0].union(parts[1]).groupBy("text_key").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))


def alignment_measures(docs: DataFrame, tokenizer: str, model: str, frequent: int = FREQUENT, parts: int = PARTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links: A-B token occurrences whose bytes overlap; n_best: those whose pair of ids is among the most
    frequent of its A id, ties included; count_sum: documents that hold the pair, summed over the links.
    Null and empty texts, and those that one of the tokenizers doesn't give back byte by byte, have
    zeros and ''. Repeated rows and missing ids stay apart; repeated texts count once per row. An
    empty table gives no rows.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    aligned = stored(aligned_texts(docs, tokenizer, model))
    counts = stored(pair_counts(aligned))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    measures = stored(aligned.drop("pairs", "times").join(link_sums(aligned, counts, frequent), "text_key", "left").select(
        "text_key", "copies", *map(zero, names), "groups_sha256"))
    rows = stored(docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("text_key")))
    # a text with a large share of all rows must not meet its measures in one task
    found = join_by_weight(rows.filter("text_key is not null"), measures, "text_key", "copies", rows.count(), parts)
    none = rows.filter("text_key is null").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names), F.lit("").alias("groups_sha256"))
    return found.select("doc_id", *names, "groups_sha256").union(none)
