"""Benchmark decontamination with one Aho-Corasick automaton over the words of all test items.

Items are cut into windows of ten words (an item of fewer words is one window). The windows become the
patterns of an automaton over word numbers, and every text runs through it once. What a match covers
is kept as a range of words and mapped back to characters of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Shipped, keep_only, pieces, stable_row, stored, text_buffer

WINDOW = 10
# (window, item) pairs of one automaton, about: some 2.6 million states. More pairs take more automata,
# each of which scans all texts.
PAIRS = 1 << 18
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Letters to lower case, everything that is no part of a word to a space.
FOLDED = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD_BYTES = re.compile(b"[0-9a-z\x80-\xff]+")
PLACES = ["first", "last", "start", "end"]
RANGES = "array<struct<first:long,last:long,start:long,end:long>>"


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (window, item_id) of ``items`` (item_id, text); a window is its words with a space between.

    Items without words have no window. Repeated rows and rows of one item_id count once.
    """
    cut = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))
    return cut.select(F.explode(windows).alias("window"), "item_id").distinct()


class Patterns:
    """Windows of one automaton with their items. Workers build the automaton from it."""

    def __init__(self, windows: list[tuple[bytes, list]]):
        self.windows = windows

    def build(self) -> tuple[dict[bytes, int], ahocorasick.Automaton]:
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in self.windows:
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in window.split(b" "))
            automaton.add_word(key, (len(key), items))
        automaton.make_automaton()
        return numbers, automaton


def joined(ranges: np.ndarray) -> np.ndarray:
    """Union of ranges of words, as rows (first, last, ...) with first <= word < last; ranges that touch
    become one, whose further columns (start, end) are those of its first and its last part."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1:], axis=0)
    opens = np.flatnonzero(np.concatenate(([True], ranges[1:, 0] > reach[:-1, 0])))
    closes = np.append(opens[1:], len(ranges)) - 1
    out = np.column_stack((ranges[opens, 0], reach[closes]))
    if ranges.shape[1] == 4:
        out[:, 2] = ranges[opens, 2]
    return out


def with_characters(raw: bytes, ranges: np.ndarray) -> np.ndarray:
    """(first, last) of words with the characters (start, end) of the original text that they cover."""
    at = np.array([m.span() for m in WORD_BYTES.finditer(raw.translate(FOLDED))])
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return np.column_stack((ranges, before[at[ranges[:, 0], 0]], before[at[ranges[:, 1] - 1, 1]]))


def _lists(found: list[np.ndarray]) -> pa.Array:
    """Ranges of every text as an array of structs."""
    flat = np.concatenate([np.empty((0, 4), np.int64), *found]).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], PLACES))


def _scanned(docs: DataFrame, patterns: Shipped, kind: str) -> DataFrame:
    """row, doc_id, n_words, ranges, items of every row, by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automaton = patterns.value.build()
        known = numbers.get
        nothing = np.empty((0, 4), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = text_buffer(piece.column(2))
                counts, ranges, items = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = raw[a:b].tobytes()
                    found = text.translate(FOLDED).split()
                    counts.append(len(found))
                    hits, own = [], set()
                    if found and numbers:
                        for last, (length, of) in automaton.iter(tuple([known(w, 0) for w in found])):
                            hits.append((last + 1 - length, last + 1))
                            own.update(of)
                    ranges.append(with_characters(text, joined(np.array(hits))) if hits else nothing)
                    items.append(list(own))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(counts, pa.int64()), _lists(ranges), pa.array(items, pa.list_(pa.string()))],
                    ["row", "doc_id", "n_words", "ranges", "items"])

    return docs.mapInArrow(run, f"{kind}, n_words long, ranges {RANGES}, items array<string>")


def _united(parts: list[DataFrame]) -> DataFrame:
    """Findings of several automata over the same rows as one; a row's lists are bounded by its text."""
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    one = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.column_stack([c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()])
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _lists([joined(flat[a:b]) for a, b in zip(ends, ends[1:])]), batch.column(4)], batch.schema.names)

    return one.mapInArrow(run, one.schema)


def contaminated_words(docs: DataFrame, items: DataFrame, size: int = WINDOW, pairs: int = PAIRS, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) held against all ``items`` (item_id, text).

    row; doc_id; n_words; n_hit: words inside an occurrence of a window; items: ids (as strings, sorted)
    of the items whose windows occur; spans: what the hit words cover, as characters of the original
    text; contaminated. A null or empty text has no words and no hits. Repeated rows stay apart. Windows
    of an item without id count as hits, but there is no id to list. Without items nothing is
    contaminated; an empty table gives no rows.

    The (window, item) pairs go into as many automata as ``pairs`` asks for; each is sent to the workers,
    so its size is bounded whatever the items. The scan shuffles nothing with one automaton; with more,
    their findings meet by row.
    """
    places = stored(item_windows(items, size).withColumn("share", F.xxhash64("window", "item_id")))
    shares = max(1, -(-places.count() // pairs))
    frame = docs.select((stable_row(docs) if row is None else row).alias("row"), "doc_id", "text")
    kinds = [frame.schema[c].dataType.simpleString() for c in ("row", "doc_id")]
    kind = f"row {kinds[0]}, doc_id {kinds[1]}"
    parts = []
    for k in range(shares):
        of: dict[str, list] = {}
        for r in places.filter(F.pmod("share", F.lit(shares)) == k).select("window", F.col("item_id").cast("string").alias("item")).toLocalIterator():
            of.setdefault(r["window"], []).extend([] if r["item"] is None else [r["item"]])
        patterns = Shipped(docs.sparkSession, Patterns([(w.encode(), ids) for w, ids in of.items()]))
        parts.append(_scanned(frame, patterns, kind))
    found = parts[0] if shares == 1 else _united(parts)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"),
                        F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
                        (F.size("ranges") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, **options) -> DataFrame:
    """Rows of ``docs`` whose share of hit words is at most ``most``, with the columns of ``docs``."""
    found = contaminated_words(docs, items, row=stable_row(docs), **options)
    return keep_only(docs, found.filter(F.col("n_hit") <= F.col("n_words") * most))
