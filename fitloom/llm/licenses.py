"""License scan by diagonal voting, in DataFrame operations only.

Every two consecutive words of a text are hashed and joined to their places in the templates. A hit
votes for the diagonal "place in the text minus place in the template"; an unbroken copy puts all its
votes on one. Neighbouring diagonals are merged, which bridges inserted or missing words, and a span
is verified by the share of the template that it really contains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import row_id

# Phrases whose places are counted, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Opening words of public licence notices.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license "
     "is distributed on an as is basis", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Stands after the last word of a text; no word contains it.
END = "\n"
COVERED = 0.8
# Diagonals at most this far apart belong to one span.
NEIGHBOUR = 2


def template_grams(spark, phrases, notices) -> DataFrame:
    """Places of all word pairs of the templates: as many rows as they have words, whatever the input.
    Template -1 is the end mark, whose place is the number of words of a text."""
    rows = [(-1, "", False, 1, 0, END, END)]
    for n, (text, label) in enumerate([*phrases, *notices]):
        words = text.split(" ")
        if len(words) < 2:
            raise ValueError(f"a template has two words at least: {text}")
        rows += [(n, label, n < len(phrases), len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, place long, word string, next string") \
        .withColumn("gram", F.xxhash64("word", "next"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Verified spans and the length of every text, one row per diagonal or span.

    row, doc_id, template, label, base, start, stop (words from 0, stop excluded), covered (share of the
    template's word pairs), exact (the whole phrase stands there consecutively). Template -1 gives each
    text's end: start is its number of words.
    """
    # the Kelvin sign is the one character that lower case turns into an ASCII letter
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ª")))
    words = docs.select(row_id().alias("row"), "doc_id", F.concat(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array(F.lit(END), F.lit(END))).alias("words"))
    grams = words.select("row", "doc_id", F.posexplode(F.arrays_zip(
        F.col("words").alias("word"), F.expr("slice(words, 2, size(words) - 1)").alias("next"))).alias("at", "pair"))
    grams = grams.select("row", "doc_id", "at", F.col("pair.word").alias("own"), F.col("pair.next").alias("follows"),
                         F.xxhash64("pair.word", "pair.next").alias("gram"))
    # the templates are constants of the call, so their table has a fixed size
    known = F.broadcast(template_grams(docs.sparkSession, phrases, notices))
    hits = grams.join(known, "gram").filter((F.col("own") == F.col("word")) & (F.col("follows") == F.col("next")))
    hits = hits.select("row", "doc_id", "template", "label", "base", "grams", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    # places are bits of 64-bit words, as many words as the template needs; one shuffle serves all that follows
    keys = ["row", "doc_id", "template", "label", "base", "grams"]
    votes = hits.withColumn("slab", F.expr("place div 64")).repartition("row").groupBy(*keys, "diagonal", "slab").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("places"))
    along = Window.partitionBy("row", "template").orderBy("diagonal", "slab")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    # phrases and end marks stand alone: their diagonals are never merged
    apart = (step > NEIGHBOUR) | (step > 0) & (F.col("base") | (F.col("template") < 0))
    bits = F.sum(F.bit_count("places"))
    spans = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("span", F.sum("new").over(along)).withColumn(
        "best", bits.over(Window.partitionBy("row", "template", "diagonal")))
    spans = spans.groupBy(*keys, "span", "slab").agg(
        F.min(F.col("diagonal") + F.col("low")).alias("start"), (F.max(F.col("diagonal") + F.col("high")) + 2).alias("stop"),
        F.bit_or("places").alias("places"), F.max("best").alias("best"))
    spans = spans.groupBy(*keys, "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), bits.alias("seen"), F.max("best").alias("best"))
    spans = spans.withColumn("covered", F.col("seen") / F.col("grams"))
    short = F.col("stop") - F.col("start") <= F.expr("grams + 1 + (grams + 1) div 2 + 2")
    verified = F.when(F.col("base") | (F.col("template") < 0), F.col("covered") == 1).otherwise(
        (F.col("best") >= COVERED * F.col("grams")) | ((F.col("covered") >= COVERED) & short))
    return spans.filter(verified).select(
        "row", "doc_id", "template", "label", "base", "start", "stop", "covered", (F.col("covered") == 1).alias("exact"))


def license_labels(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    n_base counts the places where a phrase stands, first_word and last_word are the smallest and
    largest of their starts; labels adds those of verified notices. score is the largest covered share
    of a verified template, 0 without one. A null text counts as empty; repeated rows are scanned
    again; an empty table gives no rows.
    """
    base, real = F.col("base"), F.col("template") >= 0
    joined = lambda cond: F.concat_ws(",", F.sort_array(F.collect_set(F.when(cond, F.col("label")))))
    return scan(docs, phrases, notices).groupBy("row", "doc_id").agg(
        F.max(F.when(~real, F.col("start"))).alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(real).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("covered"))), F.lit(0.0)).alias("score")).drop("row")
