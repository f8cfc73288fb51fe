"""Queries that match candidates to profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom.catalog import profiles, vectors
from fitloom.catalog.base import oracle, query, rounded
from fitloom.functions import jsontext
from fitloom.functions import vectors as V
from fitloom.functions.numbers import round_half_even
from fitloom.operators import match, profile
from fitloom.plans.analysis import analyze
from fitloom.plans.materialize import cut, no_shuffles_left, scratch
from fitloom.plans.offline import names
from fitloom.sources.history import parse_json_columns
from fitloom.streaming.scoring import score_stream

# The hashed words of two items agree in two of three words at most, so the threshold is lower
# than the one of a language model.
THRESHOLD = 0.6


# --- Spark side ----------------------------------------------------------------------------

def kb(t):
    """Profiles of the nations with their vectors."""
    nested = profile.nest_weights(profiles.weights(t)).withColumnRenamed("occ_key", "key")
    text = V.group_text(F.col("key"), names(F.col("core_skills")), names(F.col("optional_skills")),
                        F.array().cast("array<string>"))
    return nested.withColumn("embedding", V.embed(text))


def documents(t):
    """Candidates with their items and sections; a candidate's distinct items are bounded by the catalogue."""
    docs = t.candidates.groupBy("doc_id", "target_key").agg(
        F.sort_array(F.collect_list("item")).alias("skills"))
    docs = docs.withColumns({
        "user_id": F.col("doc_id").cast("long") * 3, "cv_filename": F.concat(F.lit("cv"), "doc_id", F.lit(".pdf")),
        "experience": F.array(F.concat(F.lit("worked on "), F.get("skills", F.lit(0)))),
        "projects": F.array(F.concat(F.array_join("skills", " "), F.lit(" at home"))), "education": F.array("target_key")})
    text = V.candidate_text(F.col("skills"), F.col("experience"), F.col("projects"), F.lit(""))
    return docs.withColumn("embedding", V.embed(text))


def bare(df):
    """Without the vector, where a query does not need it."""
    return df.drop("embedding")


def rows(t, mode="exact"):
    return match.match_rows(bare(documents(t)), cut(bare(kb(t))), mode, THRESHOLD)


def gaps(t):
    return match.gaps(bare(documents(t)), cut(bare(kb(t))))


# --- checking SQL --------------------------------------------------------------------------

_PAIRS = [
    ("docs", "SELECT DISTINCT doc_id, target_key FROM candidates"),
    ("group_items", "SELECT occ_key, item, lower(item) AS key, weight FROM weights"),
    ("pairs0", "SELECT doc_id, target_key, g.item, g.key, weight FROM docs JOIN group_items g ON occ_key = target_key"),
    ("matches", """SELECT p.*, c.item AS candidate, CASE WHEN c.item IS NULL THEN 0.0 ELSE 1.0 END AS similarity,
        c.item IS NOT NULL AS matched FROM pairs0 p LEFT JOIN candidates c ON c.doc_id = p.doc_id AND lower(c.item) = p.key"""),
    ("coverage", """SELECT doc_id, target_key, greatest(0.0, least(1.0, coalesce(sum(weight) FILTER (matched), 0)
        / nullif(sum(weight), 0))) AS weighted FROM matches GROUP BY doc_id, target_key"""),
]


def match_sql(select, extra=()):
    return oracle(["baskets", "candidates"], [*profiles.ctes(), *_PAIRS, *extra], select)


@query("match_exact", match_sql("""SELECT doc_id, target_key, item, weight, candidate, CAST(similarity AS DOUBLE) AS similarity
    FROM matches WHERE matched"""))
def match_exact(t):
    return rows(t).drop("key")


_SEMANTIC = [
    ("item_names", "SELECT DISTINCT item FROM group_items UNION SELECT DISTINCT item FROM candidates"),
    *vectors.slots_sql("item", "item_names", "item", "item"),
    ("sims", f"""SELECT g.item AS group_item, c.item AS cand_item, round(sum(g.value * c.value), 6) AS sim
        FROM item_vec g JOIN item_vec c USING (slot) WHERE g.item IN (SELECT item FROM group_items)
        AND c.item IN (SELECT item FROM candidates) GROUP BY 1, 2 HAVING round(sum(g.value * c.value), 6) >= {THRESHOLD}"""),
    ("hits", """SELECT doc_id, target_key, item, weight, candidate FROM matches WHERE matched"""),
    ("closest", """SELECT c.doc_id, c.target_key, g.item, g.weight, max(sim) AS sim, arg_min(c.item, (-sim, c.item)) AS candidate
        FROM candidates c JOIN sims s ON s.cand_item = c.item JOIN group_items g ON g.occ_key = c.target_key AND g.item = s.group_item
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = c.doc_id AND h.item = g.item)
        GROUP BY c.doc_id, c.target_key, g.item, g.weight"""),
]


@query("match_semantic", match_sql(f"""SELECT doc_id, target_key, item, weight, candidate, 1.0::DOUBLE AS similarity FROM hits
    UNION ALL SELECT doc_id, target_key, item, weight, candidate, {rounded('sim', 4)} FROM closest""", _SEMANTIC))
def match_semantic(t):
    return rows(t, "semantic").drop("key")


@query("weighted_score", match_sql("SELECT doc_id, target_key, round(coalesce(weighted, 0), 6) AS score FROM coverage"))
def weighted_score(t):
    return gaps(t).select("doc_id", "target_key", F.round("weighted", 6).alias("score"))


@query("final_score", oracle(["scored"], [], f"""SELECT event_id, {rounded('pred', 4)} AS semantic,
    {rounded('label', 4)} AS weighted,
    {rounded('greatest(0.0, least(1.0, 0.5::DOUBLE * pred + 0.5::DOUBLE * label))', 4)} AS match_score FROM scored"""))
def final_score(t):
    s, w = F.col("pred"), F.col("label")
    return t.scored.select(
        "event_id", round_half_even(s, 4).alias("semantic"), round_half_even(w, 4).alias("weighted"),
        round_half_even(match.final_score(s, w), 4).alias("match_score"))


@query("gap_matched", match_sql("SELECT doc_id, target_key, item FROM matches WHERE matched"))
def gap_matched(t):
    return gaps(t).select("doc_id", "target_key", F.explode("matched_skills").alias("item"))


@query("gap_missing", match_sql("""SELECT doc_id, target_key, item, CAST(row_number() OVER (
    PARTITION BY doc_id ORDER BY weight DESC, item) AS INTEGER) AS position FROM matches WHERE NOT matched AND weight >= 0.15"""))
def gap_missing(t):
    missing = gaps(t).select("doc_id", "target_key", F.posexplode("missing_skills").alias("position", "item"))
    return missing.withColumn("position", F.col("position") + 1)


@query("gap_extra", match_sql("""SELECT c.doc_id, c.target_key, c.item FROM candidates c
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = c.doc_id AND m.matched AND m.key = lower(c.item))"""))
def gap_extra(t):
    return gaps(t).select("doc_id", "target_key", F.explode("extra_skills").alias("item"))


_ANALYSIS = [
    ("doc_texts", """SELECT doc_id, concat('Skills: ', array_to_string(s, ', '), '. Key competencies: ',
        array_to_string(s, ', '), '. Experience: worked on ', s[1], '. Projects: ', array_to_string(s, ' '), ' at home.') AS text
        FROM (SELECT doc_id, list(item ORDER BY item) AS s FROM candidates GROUP BY doc_id)"""),
    ("group_lists", """SELECT occ_key,
        coalesce(list(item ORDER BY weight DESC, item) FILTER (tier = 'core'), CAST([] AS VARCHAR[])) AS core,
        coalesce(list(item ORDER BY weight DESC, item) FILTER (tier = 'optional'), CAST([] AS VARCHAR[])) AS opt
        FROM weights GROUP BY occ_key"""),
    ("group_texts", """SELECT occ_key, concat_ws(' ', concat('Occupation: ', occ_key, '.'),
        CASE WHEN len(core) > 0 THEN concat('Core skills: ', array_to_string(core, ', '), '. Key competencies: ',
            array_to_string(core, ', '), '.') END,
        CASE WHEN len(opt) > 0 THEN concat('Additional skills: ', array_to_string(opt, ', '), '.') END) AS text
        FROM group_lists"""),
    *vectors.slots_sql("doc", "doc_texts", "doc_id", "text"),
    *vectors.slots_sql("grp", "group_texts", "occ_key", "text"),
    ("doc_norms", "SELECT doc_id, sqrt(sum(value * value)) AS norm FROM doc_vec GROUP BY 1"),
    ("grp_norms", "SELECT occ_key, sqrt(sum(value * value)) AS norm FROM grp_vec GROUP BY 1"),
    ("cosines", """SELECT d.doc_id, greatest(0.0, least(1.0, sum(v.value * g.value) / any_value(dn.norm) / any_value(gn.norm))) AS semantic
        FROM docs d JOIN doc_vec v ON v.doc_id = d.doc_id JOIN grp_vec g ON g.occ_key = d.target_key AND g.slot = v.slot
        JOIN doc_norms dn ON dn.doc_id = d.doc_id JOIN grp_norms gn ON gn.occ_key = d.target_key GROUP BY d.doc_id"""),
    ("lists", """SELECT doc_id, string_agg(item, '|' ORDER BY weight DESC, item) FILTER (matched) AS matched_skills,
        string_agg(item, '|' ORDER BY weight DESC, item) FILTER (NOT matched AND weight >= 0.15) AS missing_skills
        FROM matches GROUP BY doc_id"""),
    ("extras", """SELECT doc_id, string_agg(item, '|' ORDER BY item) AS extra_skills FROM candidates c
        WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.doc_id = c.doc_id AND m.matched AND m.key = lower(c.item)) GROUP BY doc_id"""),
    ("analysis", f"""SELECT v.doc_id, v.target_key, {rounded('coalesce(semantic, 0)', 4)} AS semantic_similarity_score,
        {rounded('coalesce(weighted, 0)', 4)} AS weighted_skill_score,
        {rounded('greatest(0.0, least(1.0, 0.5::DOUBLE * coalesce(semantic, 0) + 0.5::DOUBLE * coalesce(weighted, 0)))', 4)} AS match_score,
        coalesce(matched_skills, '') AS matched_skills, coalesce(missing_skills, '') AS missing_skills,
        coalesce(extra_skills, '') AS extra_skills, replace(v.target_key, 'nation_', 'Nation ') AS occupation_display,
        array_to_string(core, '|') AS core_skills, array_to_string(s, '|') AS skills,
        CAST(v.doc_id * 3 AS BIGINT) AS user_id, concat('cv', v.doc_id, '.pdf') AS cv_filename,
        concat('worked on ', s[1]) AS experience, concat(array_to_string(s, ' '), ' at home') AS projects,
        v.target_key AS education
        FROM coverage v LEFT JOIN cosines USING (doc_id) LEFT JOIN lists USING (doc_id) LEFT JOIN extras USING (doc_id)
        LEFT JOIN (SELECT doc_id, list(item ORDER BY item) AS s FROM candidates GROUP BY doc_id) USING (doc_id)
        LEFT JOIN group_lists ON occ_key = v.target_key"""),
]
_ANALYSIS_SQL = match_sql("SELECT * FROM analysis", _ANALYSIS)


LISTS = ("matched_skills", "missing_skills", "extra_skills", "core_skills", "skills", "experience", "projects", "education")


def joined_lists(df):
    return df.withColumns({c: F.array_join(c, "|") for c in LISTS})


@query("analyze_batch", _ANALYSIS_SQL)
def analyze_batch(t):
    return joined_lists(analyze(documents(t), kb(t)))


def streamed(t, docs):
    """Folder with what a stream over ``docs`` wrote: scores, history, rejected."""
    folder = scratch(t.spark)
    with no_shuffles_left(t.spark):
        docs.write.parquet(f"{folder}/in")
        kb(t).write.parquet(f"{folder}/kb")
    arriving = t.spark.readStream.schema(t.spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    run = score_stream(arriving, t.spark.read.parquet(f"{folder}/kb"), f"{folder}/scores", f"{folder}/state",
                       f"{folder}/history", f"{folder}/rejected")
    run.awaitTermination()
    return folder


@query("stream_scoring", _ANALYSIS_SQL)
def stream_scoring(t):
    return joined_lists(t.spark.read.parquet(f"{streamed(t, documents(t))}/scores").drop("batch_id"))


@query("stream_history", match_sql("""SELECT user_id, cv_filename, target_key AS occupation_key, occupation_display, match_score,
    matched_skills, skills, experience, projects, education FROM analysis""", _ANALYSIS))
def stream_history(t):
    stored = parse_json_columns(t.spark.read.parquet(f"{streamed(t, documents(t))}/history"))
    part = lambda c: F.array_join(F.try_variant_get("candidate_profile", f"$.{c}", "array<string>"), "|").alias(c)
    return stored.select("user_id", "cv_filename", "occupation_key", "occupation_display", "match_score",
                         F.array_join("matched_skills", "|").alias("matched_skills"),
                         *[part(c) for c in ("skills", "experience", "projects", "education")])


@query("stream_rejected", oracle(["candidates"], [], """SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'vector' ELSE 'group' END AS reason
    FROM (SELECT DISTINCT doc_id FROM candidates) WHERE doc_id % 5 = 1 OR doc_id % 7 = 2"""))
def stream_rejected(t):
    docs = documents(t)
    docs = docs.withColumn("target_key", F.when(F.col("doc_id") % 7 == 2, "no_such_group").otherwise(F.col("target_key")))
    broken = F.transform("embedding", lambda x: F.when(F.col("doc_id") % 5 == 1, F.lit(float("nan"))).otherwise(x).cast("float"))
    return t.spark.read.parquet(f"{streamed(t, docs.withColumn('embedding', broken))}/rejected").select("doc_id", "reason")


def _inline_sql(column):
    return f"CASE WHEN {column} = '' THEN '(không có)' ELSE replace({column}, '|', ', ') END AS {column}"


def _bullets_sql(column):
    return f"CASE WHEN {column} = '' THEN '  (không có)' ELSE concat('  - ', replace({column}, '|', concat(chr(10), '  - '))) END AS {column}"


def _percent_sql(column):
    return f"format('{{:.0f}}', {column} * 100) AS {column}"


@query("prompt_rows", match_sql(f"""SELECT doc_id, target_key, {_percent_sql('match_score')},
    {_percent_sql('semantic_similarity_score')}, {_percent_sql('weighted_skill_score')},
    {', '.join(map(_inline_sql, jsontext.INLINE))}, {', '.join(map(_bullets_sql, jsontext.BULLETS))} FROM analysis""", _ANALYSIS))
def prompt_rows(t):
    return jsontext.prompt_fields(analyze(documents(t), kb(t)))
