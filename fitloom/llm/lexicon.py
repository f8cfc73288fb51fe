"""Byte pair encoding and decoding with a lexicon of frequent words.

The most frequent words of the corpus are compiled, with their ids, into a minimal acyclic
transducer: words with one ending share its states, and the numbers on the arcs of a path add up to
the word's place in the id table. The transducer is one file that every worker maps into memory.
Words outside it are merged exactly, so its size changes the speed and nothing else.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import most_frequent, pieces, stored
from fitloom.llm.subwords import Encoder, Splitter, Vocabulary, broadcast_vocabulary
from fitloom.plans.materialize import scratch

LEXICON_WORDS = 1 << 16
LONGEST = 64


def frequent_words(docs: DataFrame, vocab, most: int = LEXICON_WORDS, local: int = 3) -> list[bytes]:
    """The most frequent words of all texts, up to ``most``, sorted.

    Counted over whole texts; a task reports the words that it saw ``local`` times or more since it
    last emptied its table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocab.value.folded, vocab.value.special)
        seen: dict[bytes, int] = {}

        def report() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if n >= local and len(w) <= LONGEST and w[:1] != b"\xff"}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                words = splitter.split(piece.column(0))
                for w, n in zip(words.names, np.bincount(words.places, minlength=len(words.names)).tolist()):
                    seen[w] = seen.get(w, 0) + n
                if len(seen) > 500_000:
                    yield report()
        yield report()

    counts = stored(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    return sorted(bytes(r["word"]) for r in most_frequent(counts, most).collect())


class Transducer:
    """Minimal acyclic automaton over bytes whose arcs carry numbers.

    One int32 file: sizes; class of each byte; next state and number per state and class; whether a
    state ends a word; start and count of each word's ids; the ids.
    """

    HEAD = 4

    def __init__(self, flat: np.ndarray):
        states, classes, words, ids = (int(x) for x in flat[:self.HEAD])
        at = self.HEAD

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return flat[at - n:at]

        self.classes = take(256)
        self.next = take(states * classes).reshape(states, classes)
        self.number = take(states * classes).reshape(states, classes)
        self.final = take(states)
        self.starts, self.counts = take(words), take(words)
        self.ids = take(ids)

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls(np.memmap(path, np.int32, "r"))

    @classmethod
    def build(cls, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Compile sorted distinct ``words``: a word's states after its common part with the next word
        are replaced by equal ones that exist already."""
        arcs: list[dict[int, int]] = [{}]
        ends = [0]
        equal: dict[tuple, int] = {}
        path = [0]

        def share(down_to: int, word: bytes) -> None:
            while len(path) > down_to + 1:
                state = path.pop()
                same = equal.setdefault((ends[state], *arcs[state].items()), state)
                arcs[path[-1]][word[len(path) - 1]] = same

        last = b""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            share(common, last)
            for byte in word[common:]:
                arcs.append({})
                ends.append(0)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            ends[path[-1]] = 1
            last = word
        share(0, last)
        order, numbered = [0], {0: 0}
        for state in order:
            for child in arcs[state].values():
                if child not in numbered:
                    numbered[child] = len(order)
                    order.append(child)
        letters = sorted({b for w in words for b in w})
        classes = np.zeros(256, np.int32)
        classes[letters] = np.arange(1, len(letters) + 1)
        shape = (len(order), len(letters) + 1)
        following, number = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
        below: dict[int, int] = {}
        # a state is made before all states below it, apart from shared ones, so depth first
        stack = [0]
        while stack:
            state = stack[-1]
            open_ = [c for c in arcs[state].values() if c not in below]
            if open_:
                stack += open_
                continue
            stack.pop()
            total = ends[state]
            for byte, child in sorted(arcs[state].items()):
                following[numbered[state], classes[byte]] = numbered[child]
                number[numbered[state], classes[byte]] = total
                total += below[child]
            below[state] = total
        final = np.array([ends[s] for s in order], np.int32)
        starts = np.cumsum(counts) - counts
        head = np.array([*shape, len(words), len(ids)], np.int32)
        return np.concatenate([x.astype(np.int32).ravel() for x in (head, classes, following, number, final, starts, counts, ids)])

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of every word, -1 for words outside the lexicon; all words take a step at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, place = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(LONGEST + 1):
            over = lengths[live] == step
            if over.any():
                done = over & (self.final[state] == 1)
                out[live[done]] = place[done]
                live, state, place = live[~over], state[~over], place[~over]
            if not len(live):
                break
            arc = self.classes[raw[starts[live] + step]]
            place = place + self.number[state, arc]
            state = self.next[state, arc].astype(np.int64)
            on = state >= 0
            if not on.all():
                live, state, place = live[on], state[on], place[on]
        return out


class LexiconEncoder(Encoder):
    """Frequent words by the transducer, all others by merging; only the others are remembered."""

    def __init__(self, vocab: Vocabulary, lexicon: Transducer):
        self.lexicon = lexicon
        super().__init__(vocab)

    def _forget(self) -> None:
        super()._forget()
        self.starts, self.counts = self.lexicon.starts.astype(np.int64), self.lexicon.counts.astype(np.int64)
        self.ids = self.lexicon.ids.astype(np.uint32)

    def places(self, names: list[bytes]) -> np.ndarray:
        out = self.lexicon.find(names)
        rest = np.flatnonzero(out < 0)
        out[rest] = super().places([names[i] for i in rest.tolist()])
        return out


def compile_lexicon(docs: DataFrame, vocab, most: int = LEXICON_WORDS) -> str:
    """Build the lexicon of ``docs``, put it into the shared folder and have Spark hand it to every
    executor. Returns its name for `SparkFiles.get`."""
    spark = docs.sparkSession
    words = frequent_words(docs, vocab, most)
    ids, counts = vocab.value.merge(words)
    flat = Transducer.build(words, ids, counts)
    name = f"lexicon-{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath)
    raw = flat.astype("<i4").tobytes()
    for at in range(0, len(raw), 1 << 20):
        out.write(bytearray(raw[at:at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def ids_and_text(ids: np.ndarray, offsets: np.ndarray, decode) -> list[pa.Array]:
    """The ids and the decoded text of every document."""
    texts = [decode(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
    return [lists.cast(pa.list_(pa.int32())), pa.array([t.decode("utf-8", "replace") for t in texts])]


def digests(ids: np.ndarray, offsets: np.ndarray, decode) -> list[pa.Array]:
    """Number of ids, SHA-256 of the ids and of the decoded text of every document."""
    raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
    ends = offsets.tolist()
    sums = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]
    texts = [hashlib.sha256(decode(ids[a:b]).decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends, ends[1:])]
    return [pa.array(np.diff(offsets), pa.int64()), pa.array(sums), pa.array(texts)]


FORMS = {ids_and_text: "ids array<int>, decoded string",
         digests: "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def transcode(docs: DataFrame, tokenizer: str, form=ids_and_text, most: int = LEXICON_WORDS) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode the ids again.

    One row per row of ``docs``: doc_id and the columns of ``form``. A null text counts as empty and
    has no ids; an empty table gives no rows; repeated rows are encoded again.
    """
    vocab = broadcast_vocabulary(docs.sparkSession, tokenizer)
    name = compile_lexicon(docs, vocab, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {FORMS[form]}"
    columns = ["doc_id", *(c.strip().split(" ")[0] for c in FORMS[form].split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LexiconEncoder(vocab.value, Transducer.open(SparkFiles.get(name)))
        decode = vocab.value.decoder()
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, offsets = encoder.encode(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), *form(ids, offsets, decode)], columns)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
