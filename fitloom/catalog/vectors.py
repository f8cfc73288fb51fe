"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.catalog import texts
from fitloom.catalog.base import query
from fitloom.functions import vectors as V
from fitloom.operators.extract import extract_items
from fitloom.operators.neighbours import nearest_groups, pair_similarity
from fitloom.plans.offline import names
from fitloom.sources import store

DIM = 256


def numbers(column):
    return F.array_join(F.transform(column, lambda x: F.format_string("%.4f", x.cast("double"))), "|")


NUMBERS = "array_to_string(list_transform({}, lambda x: format('{{:.4f}}', x::DOUBLE)), '|')"


def slots_sql(name, source, key, text):
    """Hashed word counts of a text as (key, slot, value): the default encoder in SQL."""
    return [
        (f"{name}_words", f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '{texts.W}+')) AS word FROM {source}"),
        (f"{name}_slots", f"""SELECT {key}, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % {DIM} AS slot, count(*) AS n
            FROM {name}_words GROUP BY 1, 2"""),
        (f"{name}_vec", f"""SELECT {key}, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS value
            FROM {name}_slots"""),
    ]


def with_ctes(ctes, select):
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + select


def _sparse(t):
    """Vectors where every tenth is missing."""
    return t.embeddings.withColumn("embedding", F.when(F.col("vec_id") % 10 != 3, F.col("embedding")))


@query("kb_embeddings", f"""SELECT vec_id AS key, {NUMBERS.format('embedding')} AS embedding FROM embeddings
    WHERE vec_id % 10 <> 3""")
def kb_embeddings(t):
    kept = store.embeddings(_sparse(t).withColumnRenamed("vec_id", "key"))
    return kept.select("key", numbers("embedding").alias("embedding"))


_TEXT = """concat_ws(' ', concat('Occupation: ', occupation, '.'),
    CASE WHEN len(core_names) > 0 THEN concat('Core skills: ', array_to_string(core_names, ', '), '.') END,
    CASE WHEN len(core_names) > 0 THEN concat('Key competencies: ', array_to_string(core_names, ', '), '.') END,
    CASE WHEN len(optional_names) > 0 THEN concat('Additional skills: ', array_to_string(optional_names, ', '), '.') END,
    CASE WHEN len(segs) > 0 THEN concat('Responsibilities: ', array_to_string(
        list_transform(segs, lambda s: concat(rtrim(trim(s), '.'), '.')), ' ')) END)"""


@query("group_text", texts.postings_sql(f"SELECT occ_key, {_TEXT} AS text FROM enriched", texts._ENRICHED))
def group_text(t):
    rows = texts.enriched(t)
    return rows.select("occ_key", V.group_text(
        F.col("occupation"), names(F.col("core_skills")), names(F.col("optional_skills")),
        F.col("responsibilities")).alias("text"))


_CAND = """concat_ws(' ',
    CASE WHEN len(skills) > 0 THEN concat('Skills: ', array_to_string(skills, ', '), '.') END,
    CASE WHEN len(skills) > 0 THEN concat('Key competencies: ', array_to_string(skills, ', '), '.') END,
    CASE WHEN len(lines) > 0 THEN concat('Experience: ', array_to_string(
        list_transform(lines, lambda s: concat(rtrim(trim(s, {sp}), '.'), '.')), ' ')) END)"""


@query("candidate_text", f"""SELECT doc_id, CASE WHEN body = '' THEN text ELSE body END AS text
    FROM (SELECT doc_id, text, {_CAND.format(sp=texts.SPACES)} AS body FROM (SELECT doc_id, text,
        {texts.distinct_sql('found')} AS skills,
        CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10)) ELSE CAST([] AS VARCHAR[]) END AS lines
        FROM (SELECT *, {texts.extract_sql('text')} AS found FROM documents)))""")
def candidate_text(t):
    none = F.array().cast("array<string>")
    docs = t.documents.select(
        "doc_id", "text", extract_items(F.col("text"), texts.PATTERNS, texts.STOP).alias("skills"),
        F.when(F.col("doc_id") % 2 == 0, F.split("text", "\n")).otherwise(none).alias("lines"))
    return docs.select("doc_id", V.candidate_text(
        F.col("skills"), F.col("lines"), none, F.col("text")).alias("text"))


@query("embed_text", with_ctes(slots_sql("doc", "documents", "doc_id", "text"),
       "SELECT doc_id, CAST(slot AS INTEGER) AS slot, value FROM doc_vec"))
def embed_text(t):
    rows = t.documents.select("doc_id", V.embed(F.col("text")).alias("v"))
    # the outer form keeps a check of the list from being made below it, which would encode every text again
    return rows.select("doc_id", F.posexplode_outer("v").alias("slot", "value")).filter("value <> 0") \
        .withColumn("value", F.col("value").cast("double"))


@query("vector_guard", "SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 3 OR label = 5")
def vector_guard(t):
    broken = F.transform("embedding", lambda x: F.when(
        (F.col("vec_id") % 10 == 3) & (F.col("label") != 5) & (x == F.array_max("embedding")),
        F.lit(float("nan"))).otherwise(x))
    rows = t.embeddings.withColumn("embedding", broken)
    return rows.filter(~V.has_nan(F.col("embedding"))).select("vec_id", "label")


_NEXT = """FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _next(t):
    a = t.embeddings.select("vec_id", F.col("embedding").alias("va"), (F.col("vec_id") + 1).alias("next_id"))
    b = t.embeddings.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("vb"))
    return a.join(b, "next_id")


@query("vector_dot", f"""SELECT a.vec_id, b.vec_id AS next_id,
    round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity {_NEXT}""")
def vector_dot(t):
    return _next(t).select("vec_id", "next_id",
                           F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query("semantic_score", f"""SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN 0.0 ELSE
    round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) END AS score {_NEXT}""")
def semantic_score(t):
    scale = F.col("vec_id") % 7  # zero vectors and vectors that are not normalised
    scaled = F.transform("va", lambda x: x * scale)
    return _next(t).select("vec_id", scaled.alias("va"), "vb").select(
        "vec_id", F.round(V.semantic_score(F.col("va"), F.col("vb")), 6).alias("score"))


_CENTROIDS = [
    ("dims", "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"),
    ("means", "SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i"),
    ("centroids", "SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS c FROM means"),
]


def centroids(t):
    """One normalised mean vector per label: (key, vector)."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vecs = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    vecs = vecs.select("label", F.transform("s", lambda s: s["m"]).alias("v"))
    return vecs.withColumn("norm", F.sqrt(V.dot(F.col("v"), F.col("v")))).select(
        F.col("label").alias("key"), F.transform("v", lambda x: x / F.col("norm")).alias("vector"))


@query("knn_topk", with_ctes(_CENTROIDS, """SELECT query_id, group_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_id) AS rank FROM (
    SELECT vec_id AS query_id, c.label AS group_id, round(sum(x * c), 6) AS similarity
    FROM dims d JOIN centroids c USING (i) GROUP BY vec_id, c.label)) WHERE rank <= 3"""))
def knn_topk(t):
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    groups = centroids(t).select(F.col("key").alias("group_id"), "vector")
    return nearest_groups(queries, groups, 3).withColumn("rank", F.col("rank").cast("long"))


@query("pairwise_similarity", """SELECT a.vec_id AS a, b.vec_id AS b,
    round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label) f USING (label)
    JOIN embeddings b ON b.vec_id = first_id WHERE a.vec_id > first_id""")
def pairwise_similarity(t):
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("b"))
    pairs = t.embeddings.join(first, "label").select(F.col("vec_id").alias("a"), "b").filter("a > b")
    vecs = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return pair_similarity(pairs, vecs).withColumn("similarity", F.round("similarity", 6))
