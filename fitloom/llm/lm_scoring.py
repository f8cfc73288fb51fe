"""Language-model scores of whole texts: a unigram base and a causal self-attention model.

One pass over the texts keeps the subword ids of all of them, in blocks, and counts the words of those
outside the held-out fold. Counts of ids and of what stands before them follow from the word counts. The
model is trained on all windows of the training texts' blocks, in segments side by side, and averaged,
twice; nothing but counts of a fixed vocabulary and the parameters reach the driver. The trained model
scores the blocks, so no text is encoded again. A second pass looks up the words; only those outside the
bounded table of frequent words meet the full counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.attention import (BUCKETS, CLASSES, CONTEXT, SPAN, STEP, Model, Tables, train, window_ids, windows)
from fitloom.llm.common import Shipped, bucket_of, most_frequent, pieces, ragged, row_id, stored, text_buffer
from fitloom.llm.subwords import Encoder, broadcast_vocabulary

FOLDS, HELD_OUT = 5, 1
# One window in this many is used for training: all of them.
EVERY = 1
# Frequent words that tasks hold in memory; all others are looked up by a join.
FREQUENT = 1 << 17
# Windows that one copy of the model is trained on in a round, and such segments of a task.
TASK_WINDOWS = 1 << 14
SEGMENTS = 16
# Windows of a text that are dealt together.
BLOCK = 32
ROUNDS = 2
BATCH = 64
# Bytes of text that a worker handles at once.
PIECE = 4 << 20
END_WORD = b""


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space with A-Z in lower case: places in the distinct ones, number per
    text, and the distinct words."""
    raw, offsets = text_buffer(texts)
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] |= 32
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    start[edges] |= solid[edges]
    at = np.flatnonzero(start)
    begin = np.cumsum(solid, dtype=np.int64)[at] - 1
    data = low[solid]
    ends = np.append(begin, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    places = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return places, np.diff(np.searchsorted(at, offsets)), words.dictionary


class Subwords:
    """Subword ids of texts, by way of their distinct words, each text closed by the end id."""

    def __init__(self, vocab, most: int = 200_000):
        inner = Encoder(vocab, most=most)
        self.end = max(vocab.special.values())

        def whole(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, offsets = inner.encode(pa.array(words, pa.binary()))
            return ids, np.diff(offsets)

        # words between white space, remembered with their ids
        self.words = Encoder(vocab, whole, most)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after the other, and their number."""
        places = self.words.places(words)
        return self.words.ids[ragged(self.words.starts[places], self.words.counts[places])], self.words.counts[places]

    def of(self, places: np.ndarray, per_row: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = self.words.places(words)[places]
        counts = self.words.counts[own]
        ends = np.cumsum(counts)
        stops = np.concatenate(([0], ends))[np.cumsum(per_row)]
        flat = self.words.ids[ragged(self.words.starts[own], counts)]
        return np.insert(flat, stops, self.end), np.concatenate(([0], stops + np.arange(1, len(per_row) + 1)))


def marked(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with a number (row) and their fold (held_out). Every pass over the
    texts reads this frame, so that rows keep their numbers."""
    return docs.select(row_id().alias("row"), "doc_id", (bucket_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")


def gather(docs: DataFrame, vocab, every: int = EVERY, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """`encoded` for the training texts alone."""
    return encoded(marked(docs, folds, held_out).filter(~F.col("held_out")), vocab, every)


def encoded(texts: DataFrame, vocab, every: int = EVERY) -> DataFrame:
    """Counts (word, n) of the training texts among the `marked` ones, and subword ids (row, held_out, start,
    turn, ids) of all of them; the end of a text is the empty word. The ids of a text are cut to blocks of
    whole windows; before ``start`` stands the context of a block's first window. turn tells which of its
    windows are used for training."""
    size, context = BLOCK * STEP, CONTEXT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(vocab.value)
        seen: dict[bytes, int] = {}
        names = ["word", "n", "row", "held_out", "start", "turn", "ids"]

        def report() -> pa.RecordBatch:
            n = len(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names)
            seen.clear()
            return out

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                places, per_row, words = ascii_words(piece.column(3))
                plain = words.to_pylist()
                known = ~piece.column(2).to_numpy(zero_copy_only=False)
                counts = np.bincount(places[np.repeat(known, per_row)], minlength=len(plain))
                for w, n in zip(plain, counts.tolist()):
                    if n:
                        seen[w] = seen.get(w, 0) + n
                if known.any():
                    seen[END_WORD] = seen.get(END_WORD, 0) + int(known.sum())
                ids, offsets = subwords.of(places, per_row, plain)
                lengths = np.diff(offsets)
                n = -(-lengths // size)
                text = np.repeat(np.arange(len(lengths)), n)
                begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * size
                low, high = np.maximum(begin - context, 0), np.minimum(begin + size, lengths[text])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(high - low))), pa.int32()),
                                                 pa.array(ids[ragged(offsets[text] + low, high - low)].astype(np.int32)))
                turn = (begin // STEP + piece.column(1).to_numpy()[text]) % every
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(text), pa.binary()), pa.nulls(len(text), pa.int64()), piece.column(0).take(pa.array(text)),
                     piece.column(2).take(pa.array(text)), pa.array((begin - low).astype(np.int32)), pa.array(turn.astype(np.int32)), lists], names)
                if len(seen) > 200_000:
                    yield report()
        yield report()

    frame = texts.select("row", F.pmod(F.xxhash64("doc_id"), F.lit(every)).alias("turn"), "held_out", "text")
    return frame.mapInArrow(run, "word binary, n long, row long, held_out boolean, start int, turn int, ids array<int>")


def training_windows(start: np.ndarray, turn: np.ndarray, lists: pa.Array, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`window_ids` of blocks, for every window or for one in ``every``."""
    offsets = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy()))).astype(np.int64)
    block, first = windows(np.diff(offsets) - start)
    chosen = (first // STEP + turn[block]) % every == 0
    block, first = block[chosen], first[chosen]
    return window_ids(lists.flatten().to_numpy(), offsets, block, first + start[block])


def id_counts(counts: DataFrame, vocab) -> tuple[np.ndarray, np.ndarray]:
    """Count of every id, and of every id after ids of each bucket, from the word counts."""
    size = len(vocab.value.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(vocab.value)
        total = np.zeros((size, BUCKETS), np.int64)
        for batch in batches:
            for piece in pieces(batch, "word", PIECE):
                n = piece.column(1).to_numpy()
                ids, counts = subwords.encode(piece.column(0).to_pylist())
                times = np.repeat(n, counts)
                starts = np.cumsum(counts) - counts
                previous = np.zeros(len(ids), np.int64)
                previous[1:] = 1 + ids[:-1] % (BUCKETS - 1)
                previous[starts[starts < len(ids)]] = 0
                np.add.at(total, (ids.astype(np.int64), previous), times)
                empty = pa.compute.binary_length(piece.column(0)).to_numpy() == 0
                total[subwords.end, 0] += n[empty].sum()
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(total[i, b])], ["id", "bucket", "n"])

    # at most vocabulary x BUCKETS rows reach the driver
    got = counts.select("word", "n").mapInArrow(run, "id int, bucket int, n long").groupBy("id", "bucket").agg(F.sum("n").alias("n")).toPandas()
    before = np.zeros((size, BUCKETS))
    before[got["id"], got["bucket"]] = got["n"]
    return before.sum(1), before


def fitted(blocks: DataFrame, tables, every: int = EVERY, rounds: int = ROUNDS) -> Model:
    """Train on the windows of the blocks (start, turn, ids): in every round each segment of
    TASK_WINDOWS windows starts from the common parameters, and the results are averaged by their
    number of windows."""
    spark = blocks.sparkSession
    model = Model.fresh(tables.value.prior)
    n = blocks.agg(F.sum(F.ceil((F.size("ids") - F.col("start")) / STEP))).first()[0]
    if not n:
        return model
    # by position, so that equal blocks go different ways
    dealt = stored(blocks.withColumn("row", row_id()).repartition(-(-n // (every * SEGMENTS * TASK_WINDOWS)), "row").drop("row"))
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(model.flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tables.value
            total, seen = np.zeros(len(start.value)), 0
            kept: list[tuple[np.ndarray, ...]] = []

            def segment() -> None:
                nonlocal total, seen
                parts = [np.concatenate(x) for x in zip(*kept)]
                kept.clear()
                order = np.random.RandomState(11).permutation(len(parts[0]))
                own = order[:TASK_WINDOWS]
                kept.append(tuple(x[order[TASK_WINDOWS:]] for x in parts))
                steps = (own[at:at + BATCH] for at in range(0, len(own), BATCH))
                total += train(Model(start.value), (tuple(x[some] for x in parts) for some in steps)).flat.astype(np.float64) * len(own)
                seen += len(own)

            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    inputs, open_, targets, counted = training_windows(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), every)
                    kept.append((t.inputs(inputs), open_, t.class_of[targets].astype(np.int16), counted.astype(np.float32)))
                    while sum(len(x[0]) for x in kept) >= TASK_WINDOWS:
                        segment()
            if sum(len(x[0]) for x in kept):
                segment()
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), float(seen)))], ["at", "v", "w"])

        mean = dealt.mapInArrow(run, "at int, v double, w double").groupBy("at").agg((F.sum("v") / F.sum("w")).alias("v")).toPandas()
        if not len(mean):
            return model
        flat = model.flat.copy()
        flat[mean["at"]] = mean["v"]
        model = Model(flat)
    return model


def text_scores(ids: np.ndarray, offsets: np.ndarray, model: Model, tables: Tables, block: int = 64, start: np.ndarray | int = 0) -> np.ndarray:
    """Natural log probability of every text from its token ``start`` on: each token is scored in one window,
    ``block`` windows at a time, which stay in a core's cache."""
    start = np.broadcast_to(start, len(offsets) - 1)
    text, first = windows(np.diff(offsets) - start)
    first = first + start[text]
    out = np.zeros(len(offsets) - 1)
    # ids of some blocks of windows are looked up at once
    for low in range(0, len(text), 8 * block):
        own = text[low:low + 8 * block]
        inputs, open_, targets, counted = window_ids(ids, offsets, own, first[low:low + 8 * block])
        rows, classes = tables.inputs(inputs), np.take(tables.class_of, targets)
        score = np.take(tables.within, targets)
        for at in range(0, len(own), block):
            some = slice(at, at + block)
            score[some] += model.class_scores(rows[some], open_[some], classes[some])
        score *= counted
        np.add.at(out, own, score.sum(1))
    return out


def block_scores(blocks: DataFrame, tables, trained) -> DataFrame:
    """Log10 probability (row, score) of every block of ids (row, start, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = Model(trained.value), tables.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                offsets = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(part.column(2)).to_numpy()))).astype(np.int64)
                score = text_scores(part.column(2).flatten().to_numpy(), offsets, model, table, start=part.column(1).to_numpy()) / np.log(10)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["row", "score"])

    return blocks.select("row", "start", "ids").mapInArrow(run, "row long, score double")


def scores(docs: DataFrame, tokenizer: str, folds: int = FOLDS, held_out: int = HELD_OUT, frequent: int = FREQUENT, every: int = EVERY,
           scan: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Words stand between ASCII white space, with A-Z in lower case; the end of a text is one more token.
    base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, with their counts c in the
    training texts (crc32(doc_id) modulo ``folds`` is not ``held_out``); n_known counts those with
    c > 0, train_tokens is N. score is the log10 probability of the text's subword ids and its end,
    under a model that is trained on one window in ``every`` of the training texts.
    Two passes must give rows the same numbers. With ``scan``, ``docs`` is a plain scan of files, where they
    do; any other frame is written once first, for its rows may come in another order each time.
    A null text counts as empty; repeated rows are scored again; an empty table gives no rows.
    """
    spark = docs.sparkSession
    vocab = broadcast_vocabulary(spark, tokenizer)
    frame = marked(docs if scan else stored(docs.select("doc_id", "text")), folds, held_out)
    gathered = stored(encoded(frame, vocab, every))
    blocks = gathered.filter("ids is not null")
    counts = stored(gathered.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    divisor = total + 0.5 * (distinct + 1)
    # at most `frequent` rows
    top = {bytes(r["word"]): r["n"] for r in most_frequent(counts, frequent).collect()}
    known = spark.sparkContext.broadcast(top)
    tables = Shipped(spark, Tables(*id_counts(counts, vocab)))
    trained = spark.sparkContext.broadcast(fitted(blocks.filter("not held_out").select("start", "turn", "ids"), tables, every).flat)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = known.value.get
        end = count(END_WORD, 0)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                places, per_row, words = ascii_words(piece.column(3))
                plain = words.to_pylist()
                own = np.fromiter((count(w, 0) for w in plain), np.float64, len(plain))
                rare = own == 0
                log = np.where(rare, 0.0, np.log10((own + 0.5) / divisor))
                bounds = np.concatenate(([0], np.cumsum(per_row)))
                per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[places])))[bounds])
                base = per(log) + np.log10((end + 0.5) / divisor)
                sure = per((~rare).astype(np.int64)) + (end > 0)
                # rare words of each text once, with how often they stand there
                at = np.flatnonzero(rare[places])
                row = np.searchsorted(bounds, at, side="right") - 1
                pair, times = np.unique(row * len(plain) + places[at], return_counts=True)
                row, which = np.divmod(pair, max(1, len(plain)))
                cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [words.take(pa.array(which)).cast(pa.binary()), pa.array(times, pa.int32())], ["word", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), piece.column(2), pa.array(per_row + 1), pa.array(sure), pa.array(base), lists],
                    ["row", "doc_id", "held_out", "n_tokens", "sure", "base", "rare"])

    texts = stored(frame.mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, sure long, base double, "
             "rare array<struct<word: binary, times: int>>"))
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    # words that tasks know are frequent don't occur here
    met = rare.join(counts, "word", "left").select(
        "row", (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(divisor))).alias("log"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("long").alias("known"), F.lit(0.0).alias("score"))
    # every text has a block, since its end is a token
    whole = met.unionByName(block_scores(blocks, tables, trained).select("row", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("known"), "score")) \
        .groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known"), F.sum("score").alias("score"))
    return texts.drop("rare").join(whole, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("sure") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("log")).alias("base_score"), "score")
