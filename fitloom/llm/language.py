"""Language identification by cross-parsing entropy.

For each language a suffix automaton of the words of its labelled texts knows every substring of them.
A text is parsed greedily into the longest substrings that the automaton has, word by word, so equal
words are parsed once. Number of phrases times log2 of the sample's length, per letter, estimates the
cross entropy; the language with the least one wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Shipped, bucket_of, pieces, stored
from fitloom.llm.subwords import Splitter

FOLDS = 5
# Bounds of the labelled sample: rows of each language, and characters of a row.
SAMPLE_ROWS = 128
SAMPLE_CHARS = 2048
# Languages, and characters of the whole sample: it makes some 3 arcs of 12 bytes each at most.
LANGUAGES = 256
SAMPLE_TOTAL = 1 << 22
# A state and the letter that leaves it are one number.
LETTER_BITS = 21
UNKNOWN = "und"
EDGE = " "
# A word this many times rarer in a language than in another one is taken for a stray there.
STRAY = 8


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, folds: int = FOLDS,
                    languages: int = LANGUAGES, total: int = SAMPLE_TOTAL) -> dict[str, list[str]]:
    """At most ``rows`` texts of every language, cut to ``chars`` characters, from outside fold 0.

    Each of ``rows`` slots of a language takes the row with the least hash of its id, so the sample
    doesn't depend on partitions. Only ids are shuffled to find these rows; their texts are then picked out by a broadcast of
    at most ``rows * languages`` ids. A lang column with more values than ``languages`` is
    learned for the most frequent of them, equal ones by name. With many languages texts are cut shorter, so that all
    have ``total`` characters at most.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), folds) != 0))
    marked = labelled.select("lang", F.xxhash64("doc_id").alias("mark"), "text").withColumn("slot", F.pmod("mark", F.lit(rows)))
    chosen = stored(marked.groupBy("lang", "slot").agg(F.min("mark").alias("mark"), F.count("*").alias("n")))
    kept = stored(chosen.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang"))
    size = min(chars, max(1, total // (rows * max(1, kept.count()))))
    wanted = F.broadcast(chosen.join(F.broadcast(kept), "lang", "left_semi").select("lang", "slot", "mark"))
    # repeated ids share a mark: one of their texts is enough
    texts = marked.select("lang", "slot", "mark", F.substring("text", 1, size).alias("text")).join(
        wanted, ["lang", "slot", "mark"], "left_semi").groupBy("lang", "slot").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for row in texts.orderBy("lang", "slot").collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def letters_of(word: bytes) -> str:
    """The word if it has a letter, else nothing; an apostrophe in front does not count."""
    text = word.lstrip(b"\xff").decode()
    return text.lstrip("'") if any(map(str.isalpha, text[:3])) else ""


def suffix_automaton(words: list[str]) -> list[dict[str, int]]:
    """Arcs of the states of an automaton that accepts exactly the substrings of all ``words``."""
    arcs: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    for word in words:
        last = 0
        for char in word:
            there = arcs[last].get(char)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            new = len(arcs)
            if there is None:
                arcs.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and char not in arcs[p]:
                    arcs[p][char] = new
                    p = link[p]
                there = arcs[p][char] if p >= 0 else None
                last = new
                if there is None:
                    continue
                if length[there] == length[p] + 1:
                    link[new] = there
                    continue
            else:
                p, new = last, None
            # the state stands for strings of two lengths from here on: split it
            copy = len(arcs)
            arcs.append(dict(arcs[there]))
            link.append(link[there])
            length.append(length[p] + 1)
            while p >= 0 and arcs[p].get(char) == there:
                arcs[p][char] = copy
                p = link[p]
            link[there] = copy
            if new is None:
                last = copy
            else:
                link[new] = copy
    return arcs


class Parser:
    """Automata of all languages as sorted arcs, and phrase counts of words under each."""

    def __init__(self, sample: dict[str, list[str]]):
        splitter = Splitter()
        shares: dict[str, dict[str, float]] = {}
        self.weights: list[float] = []
        for language in sorted(sample):
            names = splitter.split(pa.array(sample[language], pa.string()))
            used = zip(map(letters_of, names.names), np.bincount(names.places, minlength=len(names.names)).tolist())
            counts = {w: n for w, n in used if w}
            if not counts:
                continue  # nothing to learn from
            size = sum((len(w) + 1) * n for w, n in counts.items())
            self.weights.append(float(np.log2(size + 2)))
            shares[language] = {w: n / size for w, n in counts.items()}
        self.languages = list(shares)
        most: dict[str, float] = {}
        for own in shares.values():
            for w, share in own.items():
                most[w] = max(share, most.get(w, 0))
        words = {k: [w for w, share in own.items() if STRAY * share >= most[w]] for k, own in shares.items()}
        self.arcs = [self._table(suffix_automaton([f"{EDGE}{w}{EDGE}" for w in words[language]])) for language in self.languages]

    @staticmethod
    def _table(arcs: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of an automaton in the order of their states and letters: as large as they are many."""
        keys = np.fromiter((state << LETTER_BITS | ord(c) for state, out in enumerate(arcs) for c in out), np.int64)
        to = np.fromiter((t for out in arcs for t in out.values()), np.int32)
        order = np.argsort(keys)
        return keys[order], to[order]

    @staticmethod
    def _follow(arcs: tuple[np.ndarray, np.ndarray], state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """States that the letters lead to, 0 where none does."""
        keys, to = arcs
        if not len(keys):
            return np.zeros(len(char), np.int64)
        wanted = state << LETTER_BITS | char
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, to[at], 0).astype(np.int64)

    def phrases(self, words: list[str]) -> np.ndarray:
        """Number of phrases of every word under every language; all words take a step at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.frombuffer((EDGE.join(words) + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        out = np.zeros((len(words), len(self.arcs)), np.int64)
        if not words:
            return out
        nothing = np.zeros(1, np.int64)
        for k, arcs in enumerate(self.arcs):
            state = np.full(len(words), self._follow(arcs, nothing, np.array([ord(EDGE)]))[0], np.int64)
            count = np.ones(len(words), np.int64)  # the phrase that is open
            for step in range(int(sizes[0])):
                live = int(np.searchsorted(-sizes, -step, side="left"))
                char = codes[starts[order[:live]] + step]
                to = self._follow(arcs, state[:live], char)
                # a new phrase begins where the open one can't go on, and after an unknown letter
                count[:live] += (to == 0) | (state[:live] == 0)
                stop = np.flatnonzero(to == 0)
                to[stop] = self._follow(arcs, np.zeros(len(stop), np.int64), char[stop])
                state[:live] = to
            out[order, k] = count
        return out


class Judge:
    """Languages of whole texts. Words seen before are remembered, up to a bound."""

    def __init__(self, parser: Parser, most: int = 400_000):
        self.parser, self.most, self.splitter = parser, most, Splitter()
        self.known: dict[bytes, int] = {}
        self.counts = np.zeros((0, len(parser.languages)), np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _places(self, names: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = {}
            self.counts, self.sizes = self.counts[:0], self.sizes[:0]
        out = np.fromiter((self.known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            plain = [names[i] for i in new.tolist()]
            words = [letters_of(w) for w in plain]
            counts = self.parser.phrases(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            counts[sizes == 0] = 0
            out[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known.update(zip(plain, out[new].tolist()))
            self.counts, self.sizes = np.concatenate((self.counts, counts)), np.concatenate((self.sizes, sizes))
        return out

    def lettered(self, texts: pa.Array) -> np.ndarray:
        """Which texts have a letter, as `judge` sees it."""
        words = self.splitter.split(texts)
        sizes = np.fromiter((len(letters_of(w)) for w in words.names), np.int64, len(words.names))
        return np.diff(np.concatenate(([0], np.cumsum(sizes[words.places])))[np.concatenate(([0], np.cumsum(words.per_row)))]) > 0

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        words = self.splitter.split(texts)
        places = self._places(words.names)[words.places]
        bounds = np.concatenate(([0], np.cumsum(words.per_row)))
        per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[places])))[bounds])
        letters = per_row(self.sizes)
        weights = np.array(self.parser.weights)
        if not len(weights):
            return [UNKNOWN] * len(letters), np.zeros(len(letters))
        cost = np.stack([per_row(self.counts[:, k]) for k in range(len(weights))], 1) * weights
        order = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(len(cost))
        best = cost[rows, order[:, 0]]
        second = cost[rows, order[:, 1]] if len(weights) > 1 else np.full(len(cost), np.inf)
        score = np.where(letters > 0, 1 - best / np.maximum(second, 1e-9), 0.0)
        names = [self.parser.languages[k] if n else UNKNOWN for k, n in zip(order[:, 0].tolist(), letters.tolist())]
        return names, score


def predictions(docs: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, lang) with lang_pred and score, and held_out: one row per row.

    Learns from text and lang of rows outside fold 0 of crc32(doc_id) modulo ``folds``; predicts from
    the whole text alone. lang_pred is a learned value, or `und` with score 0 where the text is null
    or has no letter, or nothing could be learned; score is one less the ratio of the least cost to
    the second least, 1 if one language was learned. Equal costs go to the first name. An empty table
    gives no rows.
    """
    return _judged(docs.select("doc_id", "text", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out")), docs, folds, rows, chars)


def _judged(frame: DataFrame, docs: DataFrame, folds: int, rows: int, chars: int, keep: bool = False) -> DataFrame:
    parser = Shipped(docs.sparkSession, Parser(labelled_sample(docs, rows, chars, folds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(parser.value)
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.column(piece.schema.get_field_index("text"))
                if keep and not judge.parser.languages:
                    yield piece.filter(pa.array(judge.lettered(texts)))
                    continue
                names, score = judge.judge(texts)
                if keep:
                    yield piece.filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), piece.column(2), pa.array(names, pa.string()), pa.array(score)],
                        ["doc_id", "held_out", "lang_pred", "score"])

    if keep:
        return frame.mapInArrow(run, frame.schema)
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, folds: int = FOLDS, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; where no language could be
    learned, those with a letter."""
    return _judged(docs, docs, folds, rows, chars, keep=True)
