"""Registry of the verified queries and the views they read.

Every query reads the given tables, or views derived from them; the SQL next to it is what DuckDB
runs on the same tables to check it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fitloom.sources.tables import read_table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES: dict[str, Callable[["Inputs"], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BASKET_JOIN = """
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey"""

# Each view is written so that Spark SQL and DuckDB read it alike.
VIEWS = {
    # group, row, position, item
    "baskets": f"""
SELECT n_name AS grp, o_orderkey AS row_id, l_linenumber AS pos, l_partkey AS sub_pos,
       concat(p_name, ' ', lower(p_type)) AS item {_BASKET_JOIN}""",
    # the same with three spellings of every item
    "baskets_var": f"""
SELECT n_name AS grp, o_orderkey AS row_id, l_linenumber AS pos, l_partkey AS sub_pos,
       CASE p_size % 3 WHEN 0 THEN upper(p_name)
                       WHEN 1 THEN p_name
                       ELSE concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) END AS item
{_BASKET_JOIN}""",
    # documents as postings, with every kind of missing value and list text
    "postings": """
SELECT doc_id AS row_id, lang AS category, text AS job_title,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            WHEN doc_id % 23 = 0 THEN '  '
            ELSE replace(text, '. ', concat('.', chr(10), '- ')) END AS description,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Requires ', source, ' / ', lang, ' with ', CAST(n_chars AS VARCHAR(20)), ' characters') END AS requirements_text,
       CASE WHEN doc_id % 7 = 0 THEN 'python3'
            WHEN doc_id % 7 = 1 THEN ''
            ELSE concat('[''', source, ''', ''rest api'', ''  k8s '', '''']') END AS technical_skills,
       CASE WHEN doc_id % 3 = 0 THEN '[]' ELSE '["teamwork", ''SQL'', "Rest API"]' END AS soft_skills
FROM documents""",
    # every document next to the following one
    "pairs": """
SELECT d.doc_id AS pair_id, d.text AS resume_text, b.text AS job_text,
       CAST((d.n_chars * 7 + b.n_chars * 13) % 120 - 10 AS DOUBLE) AS ai_match_score
FROM documents d JOIN documents b ON b.doc_id = d.doc_id + 1""",
    "scored": """
SELECT event_id, event_type AS method, value / 500.0 AS pred,
       CAST(event_id * 37 % 101 AS DOUBLE) / 100.0 AS label
FROM events""",
    "history": """
SELECT event_id AS id, ts AS created_at, user_id, event_type AS occupation_key,
       value / 500.0 AS match_score, props AS candidate_profile
FROM events""",
    "catalog_old": """
SELECT p_partkey AS key, p_name AS display, p_size AS core_skill_count
FROM part""",
    "catalog_new": """
SELECT p_partkey + CASE WHEN p_size > 25 THEN 1000000 ELSE 0 END AS key,
       concat(p_name, ' ', p_brand) AS display, p_size + 1 AS core_skill_count
FROM part""",
    # items a customer has bought; the target group is the next nation
    "candidates": """
SELECT DISTINCT c_custkey AS doc_id, concat('nation_', CAST((c_nationkey + 1) % 25 AS VARCHAR(10)))
       AS target_key, upper(concat(p_name, ' ', lower(p_type))) AS item
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey""",
    "uploads": """
SELECT doc_id, concat('cv', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX'
                                    WHEN 2 THEN '.txt' ELSE '.v2.docx' END) AS filename,
       CASE WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS body,
       CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * 2000 END AS n_bytes,
       concat('src', CAST(doc_id % 21 AS VARCHAR(10))) AS target_key
FROM documents""",
    "upload_groups": "SELECT DISTINCT source AS key FROM documents",
    "responses": """
SELECT event_id, CASE event_id % 5
         WHEN 0 THEN concat('{"experience": ["', event_type, '", " ", 7, true], "projects": " p', event_id, '"}')
         WHEN 1 THEN '{"experience": [], "education": 5}'
         WHEN 2 THEN 'not json'
         WHEN 3 THEN '["experience"]'
         ELSE concat('{"education": ["', event_type, '", "x"], "projects": null}') END AS body
FROM events""",
    "reviews": """
SELECT event_id, CASE event_id % 4
         WHEN 0 THEN concat('{"overall_assessment": " fit ', event_id, '", "strengths": "', event_type,
           '", "missing_skills": ["a ", "", {"skill": "', event_type, '", "level": 0, "area": "ops"}],',
           ' "learning_roadmap": [{"phase": "p1", "focus": "f", "items": ["i1", "i2"]}, " later "]}')
         WHEN 1 THEN concat('{"overall_assessment": ["x", "', event_type,
           '"], "recommendations": ["r"], "learning_roadmap": [{"giai_doan": "g", "skills": "', event_type, '"}]}')
         WHEN 2 THEN 'broken {'
         ELSE '{"strengths": 4, "cv_quality": [], "learning_roadmap": "none"}' END AS body
FROM events""",
    # catalogue entries: sources are fields, (source, lang) their positions
    "entries": """
SELECT source AS key, concat(source, '_all') AS occupation, count(*) AS core_skill_count,
       CAST(NULL AS VARCHAR(20)) AS parent, CAST(NULL AS VARCHAR(20)) AS parent_display,
       CAST(NULL AS VARCHAR(20)) AS sub_display
FROM documents GROUP BY source
UNION ALL
SELECT concat(source, '__', lang) AS key, concat(source, ' / ', lang) AS occupation,
       count(*) AS core_skill_count, source AS parent,
       CASE WHEN lang = 'en' THEN NULL ELSE concat('field ', source) END AS parent_display,
       CASE WHEN lang = 'de' THEN '' ELSE concat('position ', lang) END AS sub_display
FROM documents GROUP BY source, lang""",
}


def _names(text: str):
    return [n for n in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text))]


def view_ctes(*names: str) -> str:
    """Views as common table expressions for the checking SQL."""
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


def oracle(views, ctes, select: str) -> str:
    """SQL text from views, further (name, body) expressions and the final select."""
    parts = [view_ctes(*views)] if views else []
    parts += [f"{n} AS ({b})" for n, b in ctes]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + select


def rounded(expr: str, digits: int) -> str:
    """Half-even rounding of the binary value in DuckDB."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: int | None = None):
        self.spark, self.sf_dir, self.partitions = spark, sf_dir.rstrip("/"), partitions

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", self.partitions)

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for table in _names(text):
            if table in TABLES:
                self.table(table).createOrReplaceTempView(f"fitloom_{table}")
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", r"\1\2fitloom_\3", text))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` with its checking SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
