"""Byte pair encoding of whole columns of text with the merges of a public tokenizer file.

A text is cut into words by numpy over the UTF-8 bytes of an Arrow batch, repeated words meet in
Arrow's dictionary, and only words that a worker has not seen are merged, many at a time.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import SparkSession

from fitloom.llm.common import Shipped, ragged, text_buffer

LETTER, DIGIT, OTHER, SPACE = 0, 1, 2, 3
NEVER = np.int32(2**31 - 1)
# Words of more bytes are merged one at a time with a heap.
WIDE = 64

# How the two public tokenizers split a text into words.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space of the tokenizers; that of the regex module differs in U+001C to U+001F.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SOLID = "[^" + BLANK[1:]


def _pattern(text: str) -> regex.Pattern:
    blank_in_class = BLANK[1:-1]
    text = text.replace(r"[^\s", "[^" + blank_in_class).replace(r"\S", SOLID).replace(r"\s", BLANK)
    return regex.compile(text)


def _class_of(code: int) -> int:
    char = chr(code)
    if regex.fullmatch(BLANK, char):
        return SPACE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(char)[0], OTHER)


# Classes of U+0000..U+017F; texts with later characters are split by the pattern itself.
CLASSES = np.array([_class_of(c) for c in range(0x180)], np.uint8)
LAST_LEAD = 0xC5


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class Vocabulary:
    """Merges and words of a tokenizer file as arrays, to be broadcast; its size is that file's."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.folded = spec.get("normalizer") is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, self.ranks = self._hashed(left << 16 | right)
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"

    def decoder(self):
        """Function from ids to UTF-8 bytes: letters back to bytes where the file has a byte-level
        decoder, else the tokens with a space between them."""
        if self.bytewise:
            value = {c: b for b, c in enumerate(byte_letters())}
            special = set(self.special)
            table = [t.encode() if t in special else bytes(value[c] for c in t) for t in self.tokens]
            join = b"".join
        else:
            table, join = [t.encode() for t in self.tokens], b" ".join
        return lambda ids: join(map(table.__getitem__, ids.tolist()))

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)

    def _hashed(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: a key stands in the first free slot from its own on."""
        size = 1 << 18
        table, ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys, size).tolist())):
            while table[slot] not in (-1, key):
                slot = (slot + 1) & (size - 1)
            if table[slot] == -1:
                table[slot], ranks[slot] = key, rank
        return table, ranks

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NEVER where there is no merge."""
        keys = left.astype(np.int64) << 16 | right
        slots = self._slots(keys, len(self.keys))
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has. Exact: always the best pair first,
        the leftmost of equal ones."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in (4, 8, 16, 32, WIDE):
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(which), 1 << 16):
                some = which[at:at + (1 << 16)]
                ids, n = self._merge_block([words[i] for i in some.tolist()], lengths[some], width)
                counts[some] = n
                parts.append((some, n, ids))
        for i in np.flatnonzero(lengths > WIDE).tolist():
            ids = self._merge_long(words[i])
            counts[i] = len(ids)
            parts.append((np.array([i]), counts[i:i + 1], ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for some, n, ids in parts:
            out[ragged(starts[some], n)] = ids
        return out, counts

    def _first(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        symbols = self.inner[raw]
        symbols[ends] = self.final[raw[ends]]
        return symbols

    def _merge_block(self, words: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        flat = self._first(raw, ends - 1)
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((n, width), -1, np.int32)
        symbols[inside] = flat
        counts = lengths.copy()
        rank = np.full((n, width), NEVER, np.int32)
        pair = inside[:, 1:]
        rank[:, :-1][pair] = self.rank(symbols[:, :-1][pair], symbols[:, 1:][pair])
        done = np.empty((n, width), np.int32)
        rows = np.arange(n)
        columns = np.arange(width, dtype=np.int64)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            live = best < NEVER
            if not live.all():
                done[rows[~live]] = symbols[~live]
                rows, symbols, rank, at, best = rows[live], symbols[live], rank[live], at[live], best[live]
            if not len(rows):
                break
            # the pair at `at` becomes one symbol, all later ones move one place to the left
            source = columns + (columns > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], width - 1)
            every = np.arange(len(rows))
            symbols = np.take_along_axis(symbols, source, 1)
            symbols[:, -1] = -1
            rank = np.take_along_axis(rank, source, 1)
            rank[:, -1] = NEVER
            symbols[every, at] = self.made[best]
            counts[rows] -= 1
            size = counts[rows]
            rank[every, at] = NEVER
            to = np.flatnonzero(at + 1 < size)
            rank[to, at[to]] = self.rank(symbols[to, at[to]], symbols[to, at[to] + 1])
            to = np.flatnonzero(at > 0)
            rank[to, at[to] - 1] = self.rank(symbols[to, at[to] - 1], symbols[to, at[to]])
        return done[columns < counts[:, None]], counts

    def _merge_long(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        symbols = self._first(raw, np.array([len(raw) - 1]))
        first = self.rank(symbols[:-1], symbols[1:])
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r < NEVER]
        heapq.heapify(heap)
        symbols = symbols.tolist()

        def push(i: int) -> None:
            j = after[i]
            if j < len(symbols):
                r = self._rank_one(symbols[i], symbols[j])
                if r < NEVER:
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if symbols[i] < 0 or after[i] >= len(symbols) or self._rank_one(symbols[i], symbols[after[i]]) != r:
                continue
            j = after[i]
            symbols[i], symbols[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in symbols if s >= 0], np.int32)

    def _rank_one(self, left: int, right: int) -> int:
        key = left << 16 | right
        slot = ((key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) & (len(self.keys) - 1)
        while (found := self.keys[slot]) != -1:
            if found == key:
                return int(self.ranks[slot])
            slot = (slot + 1) & (len(self.keys) - 1)
        return int(NEVER)


def broadcast_vocabulary(spark: SparkSession, path: str):
    """Tables of the tokenizer file at ``path`` for all workers: a few MB whatever the input."""
    with open(path, encoding="utf-8") as f:
        return Shipped(spark, Vocabulary(f.read()))


def fold(text: str) -> str:
    """NFC, white space runs to one space, lower case letter by letter."""
    text = unicodedata.normalize("NFC", text)
    return regex.sub(BLANK + "+", " ", text).replace("Σ", "σ").lower()


class Words:
    """Words of some texts: places in ``names`` (distinct words) and how many each text has."""

    def __init__(self, places: np.ndarray, per_row: np.ndarray, names: list[bytes]):
        self.places, self.per_row, self.names = places, per_row, names


class Splitter:
    """Cuts texts into words: folded ones without white space, or byte-level ones that hold all of it.
    ``special`` strings are words of their own."""

    def __init__(self, folded: bool = True, special: dict[str, int] | None = None):
        self.folded = folded
        self.pattern = _pattern(FOLDED_WORDS if self.folded else BYTE_WORDS)
        self.specials = {s.encode(): i for s, i in (special or {}).items()}
        # a special string must stand apart from an ordinary word of the same letters
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None

    def split_one(self, text: str) -> list[bytes]:
        """By the pattern; specials are marked with a byte that UTF-8 never has."""
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(b"\xff" + part.encode())
            else:
                out += [w.encode() for w in self.pattern.findall(fold(part) if self.folded else part)]
        return out

    def split(self, column: pa.Array) -> Words:
        raw, offsets = text_buffer(column)
        n = len(offsets) - 1
        plain = raw
        if self.folded:
            # simple lower case keeps the number of bytes below U+0180, apart from U+0130 (excluded below)
            plain = raw.copy()
            plain[(raw >= 65) & (raw <= 90)] |= 32
        odd = (raw > LAST_LEAD) | (raw == 39)
        leads = np.flatnonzero(raw >= 0xC2)
        leads = leads[raw[leads] <= LAST_LEAD]
        codes = (raw[leads].astype(np.int64) & 31) << 6 | (raw[np.minimum(leads + 1, len(raw) - 1)] & 63)
        if self.folded:
            lower = LOWER[codes]
            odd[leads[lower < 0]] = True
            plain[leads] = 0xC0 | lower >> 6
            plain[leads + 1] = 0x80 | lower & 63
        for special in self.specials:
            first = np.flatnonzero(raw == special[0])
            for k in range(1, min(len(special), 3)):
                first = first[(first + k < len(raw))]
                first = first[raw[first + k] == special[k]]
            odd[first] = True
        kinds = np.full(256, OTHER, np.uint8)
        kinds[:128] = CLASSES[:128]
        kind = kinds[plain]
        kind[leads] = CLASSES[codes]
        kind[leads + 1] = CLASSES[codes]
        total = np.concatenate(([0], np.cumsum(odd, dtype=np.int64)))
        slow = total[offsets[1:]] > total[offsets[:-1]]
        follow = (raw & 0xC0) == 0x80
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        edge[-1] = True
        edge = edge[:len(raw)]
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[:1] = SPACE
        if self.folded:
            start = (kind != before) | (kind == DIGIT) | edge
            start &= (kind != SPACE) & ~follow
        else:
            space = kind == SPACE
            before_space = before == SPACE
            after_solid = np.zeros(len(raw), bool)  # the next character is no space and in the same text
            last = np.flatnonzero(space)
            step = last + np.where(raw[last] >= 0xC2, 2, 1)
            inside = step < len(raw)
            ok = np.zeros(len(last), bool)
            ok[inside] = (kind[step[inside]] != SPACE) & ~edge[step[inside]]
            after_solid[last] = ok
            previous_blank = np.zeros(len(raw), bool)
            previous_blank[1:] = raw[:-1] == 32
            start = np.where(space, ~before_space | after_solid, (kind != before) & ~previous_blank)
            start = (start | edge) & ~follow
        if slow.any():
            start &= ~np.repeat(slow, np.diff(offsets))
        if self.folded:
            keep = kind != SPACE
            if slow.any():
                keep &= ~np.repeat(slow, np.diff(offsets))
            at = np.flatnonzero(start)
            shift = np.cumsum(keep, dtype=np.int64)
            begin = shift[at] - 1
            data = plain[keep]
        else:
            at = np.flatnonzero(start)
            begin = at
            data = plain
            if slow.any():
                keep = ~np.repeat(slow, np.diff(offsets))
                begin = np.cumsum(keep, dtype=np.int64)[at] - 1
                data = plain[keep]
        ends = np.append(begin, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        bounds = np.searchsorted(at, offsets)
        per_row = np.diff(bounds)
        if slow.any():
            where = {w: i for i, w in enumerate(names)}
            chunks: list[np.ndarray] = []
            done = 0
            for r in np.flatnonzero(slow).tolist():
                chunks.append(places[bounds[done]:bounds[r]])
                own = self.split_one(bytes(raw[offsets[r]:offsets[r + 1]]).decode())
                found = []
                for w in own:
                    i = where.get(w)
                    if i is None:
                        i = where[w] = len(names)
                        names.append(w)
                    found.append(i)
                chunks.append(np.array(found, np.int64))
                per_row[r] = len(found)
                done = r
            chunks.append(places[bounds[done]:])
            places = np.concatenate(chunks)
        return Words(places, per_row, names)


def _lower_codes() -> np.ndarray:
    out = np.arange(0x180)
    for c in range(0x80, 0x180):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and 0x80 <= ord(low) < 0x180 else -1
    return out


LOWER = _lower_codes()


class Encoder:
    """Text columns to ids; ``merge`` turns new words into ids. The memory of known words is bounded."""

    def __init__(self, vocab: Vocabulary, merge=None, most: int = 400_000):
        self.vocab, self.splitter, self.most = vocab, Splitter(vocab.folded, vocab.special), most
        self.merge = merge or vocab.merge
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(self, names: list[bytes]) -> np.ndarray:
        """Place of every word in the memory; new words are merged first."""
        if len(self.known) > self.most:
            self._forget()
        get = self.known.get
        out = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            plain = [names[i] for i in new.tolist()]
            special = [k for k, w in enumerate(plain) if w[:1] == b"\xff"]
            ids, counts = self.merge([b"" if w[:1] == b"\xff" else w for w in plain])
            if special:
                own = np.array([self.splitter.specials[plain[k][1:]] for k in special], np.uint32)
                ids = np.insert(ids, (np.cumsum(counts) - counts)[special], own)
                counts[special] = 1
            starts = np.cumsum(counts) - counts + len(self.ids)
            out[new] = np.arange(len(self.counts), len(self.counts) + len(new))
            self.known.update(zip(plain, out[new].tolist()))
            self.starts = np.concatenate((self.starts, starts))
            self.counts = np.concatenate((self.counts, counts))
            self.ids = np.concatenate((self.ids, ids))
        return out

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        words = self.splitter.split(column)
        counts = self.counts_of(words)
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(total[np.concatenate(([0], np.cumsum(words.per_row)))])

    def counts_of(self, words: Words) -> np.ndarray:
        places = self.places(words.names)
        return self.counts[places][words.places]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 offsets of the texts."""
        words = self.splitter.split(column)
        places = self.places(words.names)[words.places]
        counts = self.counts[places]
        total = np.concatenate(([0], np.cumsum(counts)))
        offsets = total[np.concatenate(([0], np.cumsum(words.per_row)))]
        return self.ids[ragged(self.starts[places], counts)], offsets
