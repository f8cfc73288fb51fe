"""Vectors: texts to encode (E1, E2), encoder (E3), guard (E4), similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom import rules
from fitloom.functions.arrays import let
from fitloom.functions.numbers import clamp01
from fitloom.functions.text import WORD, is_blank, strip

Encoder = Callable[[list[str]], np.ndarray]
VECTOR = T.ArrayType(T.FloatType())


# Fixed values in this part: the labels before lists, which stored vectors were made with.
# --- texts ---------------------------------------------------------------------------------

def _listed(prefix: str, items: Column) -> Column:
    return F.when(F.size(items) > 0,
                  F.concat(F.lit(prefix), F.array_join(items, ", "), F.lit(".")))


def _sentences(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(F.rtrim(strip(s), F.lit(".")),
                                                              F.lit("."))), " ")


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def group_text(occupation: Column, core: Column, optional: Column, segments: Column,
               max_core: int | None = None, max_repeated: int | None = None,
               max_optional: int | None = None, max_segments: int | None = None) -> Column:
    """Text of a group; arguments are item arrays, heaviest first.

    Everything unless a limit is given; `rules.MAX_..._IN_TEXT` are those of the usual model input.
    """
    core = _first(core, max_core)
    segs = F.filter(_first(segments, max_segments), lambda s: ~is_blank(s))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Occupation: "), F.coalesce(occupation, F.lit("")), F.lit(".")),
        _listed("Core skills: ", core),
        _listed("Key competencies: ", _first(core, max_repeated)),
        _listed("Additional skills: ", _first(optional, max_optional)),
        F.when(F.size(segs) > 0, F.concat(F.lit("Responsibilities: "), _sentences(segs))))


def candidate_text(skills: Column, experience: Column, projects: Column, raw: Column,
                   max_items: int | None = None, max_repeated: int | None = None,
                   max_segments: int | None = None, max_raw: int | None = None) -> Column:
    """Text of a candidate; the raw text when the profile is empty. Limits as in `group_text`."""
    skills = _first(skills, max_items)

    def block(prefix, items):
        return F.when(F.size(items) > 0, F.concat(
            F.lit(prefix), _sentences(_first(items, max_segments))))

    text = F.concat_ws(
        " ", _listed("Skills: ", skills),
        _listed("Key competencies: ", _first(skills, max_repeated)),
        block("Experience: ", experience), block("Projects: ", projects))
    raw = F.coalesce(raw, F.lit(""))
    return F.when(text == "", raw if max_raw is None else F.substring(raw, 1, max_raw)).otherwise(text)


# --- encoder -------------------------------------------------------------------------------

class HashingEncoder:
    """Default encoder: counts of hashed words, L2-normalised, as a column expression.

    Deterministic on every machine, needs no model file, reads the whole text and stays inside the JVM.
    ``dim`` is the length of the vectors; a subclass may set another one.
    """

    dim = 256

    @classmethod
    def counts(cls, text: Column) -> Column:
        """How many words of a text fall into each of the ``dim`` slots."""
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}+"), F.lit(0))
        slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % cls.dim)
        every = F.sequence(F.lit(0).cast("long"), F.lit(cls.dim - 1).cast("long"))

        def runs(sorted_):
            # every slot stands there once more than it has words, so there are dim runs
            starts = F.array_compact(F.transform(sorted_, lambda x, i: F.when((i == 0) | (x != F.get(sorted_, F.greatest(i - 1, F.lit(0)))), i)))
            return let(starts, lambda p: F.zip_with(p, F.concat(F.slice(p, 2, cls.dim), F.array(F.size(sorted_))), lambda a, b: b - a - 1))

        return let(F.sort_array(F.concat(slots, every)), runs)

    @classmethod
    def column(cls, text: Column) -> Column:
        """The vector; that of a text without words is zero."""
        def scaled(counts):
            square = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c)
            return let(F.sqrt(square), lambda norm: F.transform(counts, lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c / norm).cast("float")))
        return let(cls.counts(text), scaled)


def embed(text: Column, make_encoder: Callable[[], Encoder] = HashingEncoder,
          batch_size: int = 16) -> Column:
    """Vector of every text.

    An encoder with a ``column`` method gives it as an expression. Any other ``make_encoder`` is
    called once per Python worker, so a model is loaded once and then fed with batches. That counts
    as non-deterministic so that a filter on the vector is not pushed below it, which would encode
    every text twice.
    """
    if hasattr(make_encoder, "column"):
        return make_encoder.column(text)

    @F.pandas_udf(VECTOR)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            texts = texts.fillna("").tolist()
            parts = [encoder(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            rows = np.concatenate(parts) if parts else np.zeros((0, 1))
            yield pd.Series(list(rows.astype(np.float32)))
    return encode.asNondeterministic()(text)


# --- similarity ----------------------------------------------------------------------------

def has_nan(v: Column) -> Column:
    """Vector that must not be used."""
    return F.exists(v, F.isnan)


def dot(a: Column, b: Column) -> Column:
    """E5: dot product, the cosine of normalised vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return let(norms, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def semantic_score(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; zero vectors give 0."""
    return clamp01(cosine(a, b))
