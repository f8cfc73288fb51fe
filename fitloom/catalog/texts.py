"""Queries over documents, pages and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitloom import rules
from fitloom.catalog.base import oracle, query, rounded
from fitloom.functions import text as X
from fitloom.functions.items import is_stop_item, item_tier, score_percent, verdict
from fitloom.functions.numbers import score_bucket
from fitloom.operators import extract, hierarchy, profile
from fitloom.plans.materialize import scratch
from fitloom.sources import postings as inputs
from fitloom.sources.taxonomy import positions

# Rules for the invented prose of the test tables.  Operators get them as arguments.
ALIASES = [
    (r"\bin\b", "into"),
    (r"\binto\s+the\b", "INTO/THE"),
    (r"\bque\b", "Qu$1e"),
    (r"\bder\b", "d&r"),
    (r"\brest\s*api\b", "REST API"),
    (r"\bk8s\b", "Kubernetes"),
]
PATTERNS = [r"\bthat\b", r"\bTHE\b", r"\bthan\b", r"\bof\s+the\b", r"tion", r"\bwith\b", r"\bque\b",
            r"\bder\b", r"\bund\b", r"\bpara\b", r"\blos\b", r"\bsql\b", r"Kubernetes", r"\bdans\b",
            r"\bmit\b", r"\bfrom\b"]
STOP = ["tion", "teamwork"]
TAXONOMY = [
    ("en", "thing", "Things", [r"\bthe\s+of\b", r"\bthing"]),
    ("en", "with", "With", [r"\bwith\b", r"\bthis\b"]),
    ("en", "rest", "Rest", [r"\bthe\b", r"\bof\b", r"\band\b"]),
    ("de", "der", "Der", [r"\bder\b", r"\bdie\b"]),
    ("de", "und", "Und", [r"\bund\b"]),
    ("fr", "les", "Les", [r"\bles\b", r"\ble\b"]),
    ("fr", "never", "Never", [r"\bzzz\b"]),
    ("es", "que", "Que", [r"\bque\b", r"\bel\b"]),
]


# --- checking SQL --------------------------------------------------------------------------
# RE2 knows only ASCII word borders, so borders are written as captured neighbours; a replacement
# runs twice because neighbouring matches share the character between them.

W, NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
SPACES = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ', chr(28), chr(29), chr(30), chr(31), chr(133), chr(160), chr(8232), chr(8233))"


def trim_sql(e):
    return f"trim({e}, {SPACES})"


def html_sql(e):
    return f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"


def urls_sql(e):
    e = f"regexp_replace({e}, 'https?://[^\\s\\p{{Z}}]+|www\\.[^\\s\\p{{Z}}]+', ' ', 'g')"
    return f"regexp_replace({e}, '[^\\s\\p{{Z}}]+@[^\\s\\p{{Z}}]+\\.[^\\s\\p{{Z}}]+', ' ', 'g')"


def special_sql(e):
    return f"regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}+#/.\\-,;:!?()\\[\\]]', ' ', 'g')"


def ws_sql(e):
    e = f"regexp_replace({e}, '[\\t\\r\\f\\x0b]+', ' ', 'g')"
    e = f"regexp_replace({e}, '\\n{{3,}}', concat(chr(10), chr(10)), 'g')"
    return trim_sql(f"regexp_replace({e}, ' {{2,}}', ' ', 'g')")


def _core(pattern):
    return pattern.replace(r"\b", "")


def alias_sql(e, table=ALIASES):
    for p, r in table:
        for _ in range(2):
            e = f"regexp_replace({e}, '(^|{NW})(?:{_core(p)})({NW}|$)', '\\1{r}\\2', 'gi')"
    return e


def clean_sql(e):
    chain = ws_sql(special_sql(alias_sql(urls_sql(html_sql(f"nfc_normalize({e})")))))
    return f"CASE WHEN {e} IS NULL OR {trim_sql(e)} = '' THEN '' ELSE {chain} END"


def parse_sql(e):
    """Lists in the views are plainly quoted; anything else is one item."""
    body = trim_sql(e)
    inner = f"regexp_extract_all({body}, '''([^'']*)''|\"([^\"]*)\"', 0)"
    items = f"list_transform({inner}, lambda x: {trim_sql('substr(x, 2, length(x) - 2)')})"
    return (f"CASE WHEN {e} IS NULL OR {body} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN starts_with({body}, '[') THEN list_filter({items}, lambda x: x <> '') ELSE [{body}] END")


def clean_list_sql(e):
    cleaned = f"list_transform({parse_sql(e)}, lambda y: {clean_sql('y')})"
    return f"list_filter({cleaned}, lambda x: x <> '')"


def distinct_sql(lst, key="lower({})"):
    """Ordered distinct by key."""
    x, y = key.format("x"), key.format("y")
    return (f"list_filter({lst}, lambda x, i: list_position(list_transform({lst}, lambda y: {y}), {x}) = i)")


def extract_sql(e):
    found = []
    for p in PATTERNS:
        if p.startswith(r"\b"):
            found.append(f"regexp_extract({e}, '(?:^|{NW})({_core(p)})(?:{NW}|$)', 1, 'i')")
        else:
            found.append(f"regexp_extract({e}, '{p}', 0, 'i')")
    stop = ", ".join(f"'{s}'" for s in STOP)
    return f"list_filter([{', '.join(found)}], lambda x: x <> '' AND lower(x) NOT IN ({stop}))"


def joined(lst):
    return f"coalesce(array_to_string({lst}, '|'), '')"


_CLEANED = [
    ("valid", f"""SELECT * FROM postings WHERE category IS NOT NULL AND job_title IS NOT NULL
        AND description IS NOT NULL AND NOT ({trim_sql('description')} = ''
        AND {trim_sql("coalesce(requirements_text, '')")} = '')"""),
    ("cleaned0", f"""SELECT row_id, category, job_title, {clean_sql('description')} AS description,
        {clean_sql('requirements_text')} AS requirements_text,
        {clean_list_sql('technical_skills')} AS technical_skills_parsed,
        {clean_list_sql('soft_skills')} AS soft_skills_parsed FROM valid"""),
    ("cleaned", f"""SELECT * FROM (SELECT *, concat_ws(chr(10), nullif(description, ''),
        nullif(requirements_text, ''), nullif(array_to_string(technical_skills_parsed, ', '), ''),
        nullif(array_to_string(soft_skills_parsed, ', '), '')) AS full_text FROM cleaned0)
        WHERE {trim_sql('full_text')} <> ''"""),
    ("keyed", f"SELECT *, {extract_sql('full_text')} AS found FROM cleaned"),
    ("merged", f"""SELECT *, {distinct_sql("found")} AS keywords FROM keyed"""),
    ("listed", f"""SELECT *, list_filter(list_concat(technical_skills_parsed, soft_skills_parsed, keywords),
        lambda x: length(x) >= 2 AND lower(x) NOT IN ({", ".join(f"'{s}'" for s in STOP)})) AS all_items FROM merged"""),
    ("segments", f"""SELECT row_id, i, trim(seg, {SPACES}) AS seg FROM (SELECT row_id,
        unnest(regexp_split_to_array(CASE WHEN {trim_sql('description')} = '' THEN requirements_text ELSE description END,
            '[\\n\\r][-•*–]\\s*|[\\n\\r]\\d+[.)]\\s+|[\\n\\r]{{2,}}')) AS seg,
        generate_subscripts(regexp_split_to_array(CASE WHEN {trim_sql('description')} = '' THEN requirements_text ELSE description END,
            '[\\n\\r][-•*–]\\s*|[\\n\\r]\\d+[.)]\\s+|[\\n\\r]{{2,}}'), 1) AS i FROM cleaned)"""),
    ("seg_firsts", f"""SELECT row_id, min(i) AS i, arg_min(seg, i) AS seg FROM segments WHERE length(seg) >= 20
        GROUP BY row_id, lower(seg)"""),
    ("seg_ranked", "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) AS pos FROM seg_firsts"),
    ("seg_lists", """SELECT row_id, list(seg ORDER BY pos) AS responsibilities FROM seg_ranked
        GROUP BY row_id"""),
    ("records", f"""SELECT l.row_id, category AS occupation, {distinct_sql('all_items')} AS skills,
        coalesce(responsibilities, CAST([] AS VARCHAR[])) AS responsibilities
        FROM listed l LEFT JOIN seg_lists USING (row_id)"""),
]


def postings_sql(select, extra=()):
    return oracle(["postings"], [*_CLEANED, *extra], select)


# --- Spark side ----------------------------------------------------------------------------

def cleaned_postings(t):
    return extract.clean_postings(inputs.valid_postings(t.postings), ALIASES)


def records(t):
    return extract.extract_all(cleaned_postings(t), PATTERNS, STOP)


# --- A1, A2 --------------------------------------------------------------------------------

@query("load_postings", postings_sql("SELECT row_id, category, job_title, description FROM valid"))
def load_postings(t):
    return inputs.valid_postings(t.postings).select("row_id", "category", "job_title", "description")


CSV_COLUMNS = ["row_id", "category", "job_title", "description", "requirements_text"]


def posting_lines(t):
    """The postings as CSV, of which some records are short, long, or have commas without quotes."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    number = F.col("row_id").cast("string")
    fields = [number, *(quoted(F.col(c)) for c in CSV_COLUMNS[1:])]
    line = (F.when(F.col("row_id") % 29 == 1, F.concat_ws(",", *fields[:3]))
            .when(F.col("row_id") % 31 == 2, F.concat_ws(",", *fields, F.lit("more"), F.lit('""')))
            .when(F.col("row_id") % 37 == 3, F.concat_ws(",", number, F.lit("a,b"), *fields[2:]))
            .otherwise(F.concat_ws(",", *fields)))
    return t.postings.select(line.alias("value"))


_LINES = ("read", """SELECT *, CASE WHEN row_id % 29 = 1 OR row_id % 31 = 2 OR row_id % 37 = 3 THEN 'columns'
    WHEN category IS NULL THEN 'no category' WHEN description IS NULL THEN 'no description'
    WHEN trim(description) = '' AND trim(coalesce(requirements_text, '')) = '' THEN 'blank' END AS reason FROM postings""")


@query("load_rejected", oracle(["postings"], [_LINES], """SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(reason, 'kept') AS reason,
    CASE WHEN reason IS NULL THEN md5(description) END AS description, (SELECT count(*) FROM read) AS n_read,
    (SELECT count(reason) FROM read) AS n_rejected FROM read"""))
def load_rejected(t):
    path = f"{scratch(t.spark)}/csv"
    posting_lines(t).write.text(path)
    found = inputs.check_postings(t.spark, path, "row_id", CSV_COLUMNS)
    kept = found.kept.select("row_id", F.lit("kept").alias("reason"), F.md5("description").alias("description"))
    return kept.union(found.rejected.select("row_id", "reason", F.lit(None).cast("string"))).withColumns({
        "n_read": F.lit(found.counts["read"]).cast("long"), "n_rejected": F.lit(found.counts["rejected"]).cast("long")})


_VALID_PAIRS = ("valid_pairs", """SELECT * FROM pairs WHERE resume_text IS NOT NULL AND job_text IS NOT NULL
    AND ai_match_score BETWEEN 0 AND 100""")


@query("load_pairs", oracle(["pairs"], [_VALID_PAIRS],
       "SELECT pair_id, md5(resume_text) AS resume, md5(job_text) AS job, ai_match_score FROM valid_pairs"))
def load_pairs(t):
    return inputs.valid_pairs(t.pairs).select(
        "pair_id", F.md5("resume_text").alias("resume"), F.md5("job_text").alias("job"), "ai_match_score")


# --- B1-B7 ---------------------------------------------------------------------------------

_SPLIT = "replace(replace(text, 'é', 'é'), 'ü', 'ü')"


@query("nfc", f"SELECT doc_id, nfc_normalize({_SPLIT}) AS text FROM documents")
def nfc(t):
    split = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü"))
    return t.documents.select("doc_id", X.nfc(split).alias("text"))


def _on_pages(name, sql_fn, fn):
    @query(name, f"SELECT page_id, {sql_fn('html')} AS text FROM pages")
    def run(t):
        return t.pages.select("page_id", fn(F.col("html")).alias("text"))
    return run


_on_pages("strip_html", html_sql, X.strip_html)
_on_pages("strip_urls", urls_sql, X.strip_urls)
_on_pages("strip_special", special_sql, X.strip_special)
_on_pages("norm_ws", ws_sql, X.normalize_ws)
_on_pages("clean_text", clean_sql, lambda c: X.clean_text(c, ALIASES))


@query("alias_rewrite", f"SELECT doc_id, {alias_sql('text')} AS text FROM documents")
def alias_rewrite(t):
    return t.documents.select("doc_id", X.rewrite_aliases(F.col("text"), ALIASES).alias("text"))


# --- B8-B15 --------------------------------------------------------------------------------

def _list_query(name, sql_fn, fn):
    @query(name, oracle(["postings"], [], f"""SELECT row_id, {joined(sql_fn('technical_skills'))} AS technical,
        {joined(sql_fn('soft_skills'))} AS soft FROM postings"""))
    def run(t):
        return t.postings.select("row_id", *[
            F.array_join(fn(F.col(f"{c}_skills")), "|").alias(c) for c in ("technical", "soft")])
    return run


_list_query("parse_list", parse_sql, X.parse_list)
_list_query("clean_list", clean_list_sql, lambda c: X.clean_list(c, ALIASES))


@query("clean_postings", postings_sql(f"""SELECT row_id, description, requirements_text,
    {joined('technical_skills_parsed')} AS technical, {joined('soft_skills_parsed')} AS soft, full_text FROM cleaned"""))
def clean_postings(t):
    return cleaned_postings(t).select(
        "row_id", "description", "requirements_text",
        F.array_join("technical_skills_parsed", "|").alias("technical"),
        F.array_join("soft_skills_parsed", "|").alias("soft"), "full_text")


_CLEAN_PAIRS = ("clean_pairs", f"""SELECT * FROM (SELECT pair_id, {clean_sql('resume_text')} AS resume_text,
    {clean_sql('job_text')} AS job_text, ai_match_score FROM pairs)
    WHERE {trim_sql('resume_text')} <> '' AND {trim_sql('job_text')} <> ''""")


@query("clean_pairs", oracle(["pairs"], [_CLEAN_PAIRS], "SELECT pair_id, resume_text, job_text FROM clean_pairs"))
def clean_pairs(t):
    return extract.clean_pairs(t.pairs, ALIASES).select("pair_id", "resume_text", "job_text")


@query("truncate_text", "SELECT doc_id, substr(text, 1, 3000) AS resume, substr(text, 1, 2000) AS job FROM documents")
def truncate_text(t):
    c = F.col("text")
    return t.documents.select("doc_id", X.truncate(c, rules.MAX_RESUME_CHARS).alias("resume"),
                              X.truncate(c, rules.MAX_JOB_CHARS).alias("job"))


_LABEL = "concat('  ', source, ' Of ', text, '_x ')"


def _label():
    return F.concat(F.lit("  "), "source", F.lit(" Of "), "text", F.lit("_x "))


@query("group_key", f"SELECT doc_id, replace(lower({trim_sql(_LABEL)}), ' ', '_') AS occ_key FROM documents")
def group_key(t):
    return t.documents.select("doc_id", X.group_key(_label()).alias("occ_key"))


_NAME = trim_sql(f"replace({_LABEL}, '_', ' ')")


@query("display_name", f"""SELECT doc_id, concat(upper(substr(name, 1, 1)), substr(name, 2)) AS display
    FROM (SELECT doc_id, {_NAME} AS name FROM documents)""")
def display_name(t):
    return t.documents.select("doc_id", X.display_name(_label()).alias("display"))


@query("slug", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)),
    '{NW}', '_', 'g'), '_+', '_', 'g'), '_') AS slug FROM documents""")
def slug(t):
    return t.documents.select("doc_id", X.slug(F.col("text")).alias("slug"))


# --- B17-B20 -------------------------------------------------------------------------------

def _assign_sql(title, parent):
    whens = " ".join(
        f"WHEN {parent} = '{p}' AND regexp_matches({title}, '(?i)(?:" + "|".join(
            f"(?:^|{NW})(?:{_core(x)})" + (f"(?:{NW}|$)" if x.endswith(r"\b") else "") for x in pats)
        + f")') THEN '{k}'" for p, k, _d, pats in TAXONOMY)
    return f"CASE {whens} END"


_ASSIGNED = ("assigned", f"SELECT *, category AS parent, {_assign_sql('job_title', 'category')} AS sub FROM postings")


@query("taxonomy_assign", oracle(["postings"], [_ASSIGNED], "SELECT row_id, parent, sub FROM assigned"))
def taxonomy_assign(t):
    return hierarchy.assign_postings(t.postings, TAXONOMY).select("row_id", "parent", "sub")


@query("score_bucket", oracle(["scored"], [], """SELECT event_id, least(CAST(trunc(pred * 5) AS INTEGER), 4) AS bucket
    FROM scored"""))
def score_bucket_query(t):
    return t.scored.select("event_id", score_bucket(F.col("pred")).alias("bucket"))


@query("verdict_band", oracle(["scored"], [("pct", f"""SELECT event_id,
    {rounded('least(greatest(pred * 1.2 - 0.05, 0.0), 1.0) * 100', 1)} AS percent FROM scored""")],
    f"""SELECT event_id, percent, CASE WHEN percent >= 70 THEN '{rules.VERDICT_LABELS[0]}'
    WHEN percent >= 40 THEN '{rules.VERDICT_LABELS[1]}' ELSE '{rules.VERDICT_LABELS[2]}' END AS verdict FROM pct"""))
def verdict_band(t):
    pct = t.scored.select("event_id", score_percent(F.col("pred") * 1.2 - 0.05).alias("percent"))
    return pct.withColumn("verdict", verdict(F.col("percent")))


@query("skill_tier", oracle(["scored"], [], """SELECT event_id, CASE WHEN pred >= 0.4 THEN 'core'
    WHEN pred >= 0.15 THEN 'important' ELSE 'supporting' END AS tier FROM scored"""))
def skill_tier(t):
    return t.scored.select("event_id", item_tier(F.col("pred")).alias("tier"))


# --- C1-C6 ---------------------------------------------------------------------------------

@query("extract_items", f"""SELECT doc_id, {joined(distinct_sql('found'))} AS items
    FROM (SELECT doc_id, {extract_sql('text')} AS found FROM documents)""")
def extract_items(t):
    return t.documents.select("doc_id", F.array_join(
        extract.extract_items(F.col("text"), PATTERNS, STOP), "|").alias("items"))


@query("stop_filter", """SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE lower(trim(word, concat(chr(10), ' '))) NOT IN ('the', 'of', 'que', 'und', 'tion')""")
def stop_filter(t):
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.filter(~is_stop_item(F.col("word"), ["the", "of", "que", "und", "tion"]))


@query("merge_items", postings_sql(f"SELECT row_id, {joined(distinct_sql('all_items'))} AS items FROM listed"))
def merge_items(t):
    rows = cleaned_postings(t).withColumn(
        "keywords", extract.extract_items(F.col("full_text"), PATTERNS, STOP))
    return rows.select("row_id", F.array_join(extract.merge_items(
        F.col("technical_skills_parsed"), F.col("soft_skills_parsed"), F.col("keywords"),
        stop_items=STOP), "|").alias("items"))


@query("segment_text", postings_sql("""SELECT row_id, CAST(pos AS INTEGER) AS pos, seg FROM seg_ranked"""))
def segment_text(t):
    rows = cleaned_postings(t).select("row_id", F.posexplode(
        extract.segments(F.col("description"), F.col("requirements_text"))).alias("pos", "seg"))
    return rows.withColumn("pos", F.col("pos") + 1)


@query("extract_all", postings_sql(f"""SELECT row_id, occupation, {joined('skills')} AS skills,
    {joined('responsibilities')} AS responsibilities FROM records"""))
def extract_all(t):
    return records(t).select("row_id", "occupation", F.array_join("skills", "|").alias("skills"),
                             F.array_join("responsibilities", "|").alias("responsibilities"))


@query("candidate_items", f"""SELECT page_id, {joined(distinct_sql('found'))} AS items
    FROM (SELECT page_id, {extract_sql('clean')} AS found FROM (SELECT page_id, {clean_sql('html')} AS clean FROM pages))""")
def candidate_items(t):
    found = extract.candidate_items(t.pages, "html", "skills", PATTERNS, STOP, ALIASES)
    return found.select("page_id", F.array_join("skills", "|").alias("items"))


# --- D4, D18, D23, D24, D26 ----------------------------------------------------------------

_GROUP_SEGMENTS = [
    ("flat", """SELECT replace(lower(trim(occupation)), ' ', '_') AS occ_key, row_id,
        unnest(responsibilities) AS seg, generate_subscripts(responsibilities, 1) AS pos FROM records"""),
    ("flat_firsts", """SELECT *, row_number() OVER (PARTITION BY occ_key, lower(seg)
        ORDER BY row_id, pos) AS rn FROM flat WHERE length(seg) >= 15"""),
    ("group_segs", """SELECT * FROM (SELECT occ_key, seg, row_number() OVER (PARTITION BY occ_key ORDER BY row_id, pos)
        AS rank FROM flat_firsts WHERE rn = 1)"""),
]


@query("group_segments", postings_sql("SELECT occ_key, CAST(rank AS INTEGER) AS rank, seg FROM group_segs", _GROUP_SEGMENTS))
def group_segments(t):
    return profile.group_segments(profile.known_groups(records(t))).select("occ_key", F.col("rank").cast("int").alias("rank"), "seg")


def _record_ctes(keys):
    """Weights of extracted records; the last of ``keys`` names the group."""
    k, *corpus = ", ".join(keys), *keys[:-1]
    per = f"PARTITION BY {', '.join(corpus)}" if corpus else ""
    match = " AND ".join(f"d.{c} = f.{c}" for c in corpus) or "TRUE"
    n = (f"(SELECT count(*) FROM r_sizes z WHERE z.{corpus[0]} = f.{corpus[0]})" if corpus
         else "(SELECT count(*) FROM r_sizes)")
    head = (", ".join(corpus) + ", ") if corpus else ""
    return [
        ("r_items", f"SELECT {k}, row_id, unnest(skills) AS item FROM r_records"),
        ("r_sizes", f"SELECT {k}, count(*) AS jd_count, arg_max(occupation, row_id) AS occupation FROM r_records GROUP BY {k}"),
        ("r_kept", f"""SELECT i.*, jd_count FROM (SELECT {k}, item, count(*) AS count FROM r_items GROUP BY {k}, item) i
            JOIN r_sizes USING ({k}) WHERE count >= greatest(2, CAST(floor(jd_count * 0.01) AS BIGINT))"""),
        ("r_freq", f"SELECT *, {rounded('count / jd_count', 6)} AS frequency FROM r_kept"),
        ("r_df", f"SELECT {head}lower(item) AS low, count(DISTINCT {keys[-1]}) AS df FROM r_kept GROUP BY {head}lower(item)"),
        ("r_raw", f"""SELECT f.*, frequency * ln(1 + {n} / (1 + df)) AS raw FROM r_freq f
            JOIN r_df d ON {match} AND lower(f.item) = d.low"""),
        ("r_span", f"""SELECT *, min(raw) OVER g AS r0, max(raw) OVER g AS r1, min(frequency) OVER g AS f0,
            max(frequency) OVER g AS f1 FROM r_raw WINDOW g AS (PARTITION BY {k})"""),
        ("r_scored", f"""SELECT *,
            CASE WHEN r1 = r0 THEN 0.5 ELSE {rounded('(raw - r0) / nullif(r1 - r0, 0)', 6)} END AS tfidf,
            CASE WHEN f1 = f0 THEN 0.5 ELSE {rounded('(frequency - f0) / nullif(f1 - f0, 0)', 6)} END AS freq_norm FROM r_span"""),
        ("r_blend", f"SELECT *, {rounded('0.8::DOUBLE * freq_norm + 0.2::DOUBLE * tfidf', 4)} AS weight FROM r_scored"),
        ("r_weights", "SELECT *, CASE WHEN weight >= 0.35 THEN 'core' ELSE 'optional' END AS tier FROM r_blend"),
    ]


_ENRICHED = [
    ("r_records", "SELECT *, replace(lower(trim(occupation)), ' ', '_') AS occ_key FROM records"),
    *_record_ctes(["occ_key"]), *_GROUP_SEGMENTS,
    ("r_nested", """SELECT occ_key,
        coalesce(string_agg(concat(item, '=', format('{:.4f}', weight)), '|' ORDER BY weight DESC, item) FILTER (tier = 'core'), '') AS core_skills,
        coalesce(string_agg(concat(item, '=', format('{:.4f}', weight)), '|' ORDER BY weight DESC, item) FILTER (tier = 'optional'), '') AS optional_skills,
        coalesce(list(item ORDER BY weight DESC, item) FILTER (tier = 'core'), CAST([] AS VARCHAR[])) AS core_names,
        coalesce(list(item ORDER BY weight DESC, item) FILTER (tier = 'optional'), CAST([] AS VARCHAR[])) AS optional_names
        FROM r_weights GROUP BY occ_key"""),
    ("r_segs", "SELECT occ_key, list(seg ORDER BY rank) AS segs FROM group_segs GROUP BY occ_key"),
    ("enriched", """SELECT s.occ_key, occupation, jd_count, coalesce(core_skills, '') AS core_skills,
        coalesce(optional_skills, '') AS optional_skills, core_names, optional_names, segs
        FROM r_sizes s LEFT JOIN r_nested USING (occ_key) LEFT JOIN r_segs USING (occ_key)"""),
]


def enriched(t):
    from fitloom.plans.offline import profile_parts
    parts = profile_parts(records(t))
    return profile.enrich(parts["weights"], parts["sizes"], parts["segments"])


def entries(column):
    return F.array_join(F.transform(column, lambda s: F.concat(
        s["item"], F.lit("="), F.format_string("%.4f", s["weight"]))), "|")


@query("enriched_profile", postings_sql(f"""SELECT occ_key, occupation, jd_count, core_skills, optional_skills,
    {joined('segs')} AS responsibilities FROM enriched""", _ENRICHED))
def enriched_profile(t):
    return enriched(t).select(
        "occ_key", "occupation", "jd_count", entries("core_skills").alias("core_skills"),
        entries("optional_skills").alias("optional_skills"),
        F.array_join("responsibilities", "|").alias("responsibilities"))


_SUB_PARTS = [
    (n, b.replace("FROM valid", f"FROM (SELECT *, category AS parent, {_assign_sql('job_title', 'category')} AS sub FROM valid) WHERE sub IS NOT NULL")
     .replace("SELECT row_id, category, job_title", "SELECT row_id, parent, sub, category, job_title")
     .replace("category AS occupation", "parent, sub AS occupation"))
    if n in ("cleaned0", "records") else (n, b) for n, b in _CLEANED]
_SUB = [*_SUB_PARTS,
        ("r_records", "SELECT *, occupation AS occ_key FROM records"), *_record_ctes(["parent", "occ_key"]),
        ("seen_once", """SELECT parent, occ_key, lower(item) AS low, item AS canon, row_number() OVER (
            PARTITION BY parent, occ_key, lower(item) ORDER BY tier, weight DESC, item) AS rn FROM r_weights"""),
        ("best", """SELECT parent, low, canon AS display FROM (SELECT *, row_number() OVER (PARTITION BY parent, low ORDER BY n DESC,
            CASE WHEN substr(canon, 1, 1) = upper(substr(canon, 1, 1)) AND substr(canon, 1, 1) <> lower(substr(canon, 1, 1))
            THEN 0 ELSE 1 END, canon) AS rn FROM (SELECT parent, low, canon, count(*) AS n FROM seen_once WHERE rn = 1 GROUP BY ALL))
            WHERE rn = 1"""),
        ("merged_tiers", """SELECT w.parent, occ_key, tier, display AS item, max(weight) AS weight FROM r_weights w
            JOIN best b ON b.parent = w.parent AND lower(item) = low GROUP BY ALL""")]


@query("sub_profiles", oracle(["postings"], _SUB, """SELECT parent, occ_key, item, weight, tier FROM merged_tiers b
    WHERE tier = 'core' OR NOT EXISTS (SELECT 1 FROM merged_tiers c WHERE c.parent = b.parent AND c.occ_key = b.occ_key
    AND c.tier = 'core' AND lower(c.item) = lower(b.item))"""))
def sub_profiles(t):
    return hierarchy.sub_profiles(inputs.valid_postings(t.postings), TAXONOMY, PATTERNS, STOP, ALIASES)


_POSITIONS = "(VALUES " + ", ".join(f"('{p}', '{k}', '{d}')" for p, k, d, _ in TAXONOMY) + ") p(parent, sub, display)"


@query("sub_coverage", oracle(["postings"], [_ASSIGNED], f"""SELECT p.parent, p.sub, p.display, count(row_id) AS n_rows
    FROM {_POSITIONS} LEFT JOIN assigned a ON a.parent = p.parent AND a.sub = p.sub GROUP BY ALL"""))
def sub_coverage(t):
    return hierarchy.sub_coverage(hierarchy.assign_postings(t.postings, TAXONOMY),
                                  positions(t.spark, TAXONOMY))


_CATALOGUE = ("catalogue", """SELECT key, display, core_skill_count, coalesce(parent, key) AS parent_key,
    CASE WHEN parent IS NULL THEN display ELSE coalesce(nullif(parent_display, ''),
        concat(upper(substr(parent, 1, 1)), substr(replace(parent, '_', ' '), 2))) END AS parent_display,
    CASE WHEN parent IS NOT NULL THEN coalesce(nullif(sub_display, ''), display) END AS sub_display,
    parent IS NOT NULL AS is_sub
    FROM (SELECT *, concat(upper(substr(n, 1, 1)), substr(n, 2)) AS display
          FROM (SELECT *, trim(replace(occupation, '_', ' ')) AS n FROM entries))""")


@query("group_catalogue", oracle(["entries"], [_CATALOGUE], "SELECT * FROM catalogue"))
def group_catalogue(t):
    return hierarchy.catalogue(t.entries)


@query("group_hierarchy", oracle(["entries"], [_CATALOGUE], f"""SELECT parent_key, '{rules.GENERAL_ENTRY}' AS label,
    parent_key AS key, 0 AS position FROM catalogue GROUP BY parent_key UNION ALL
    SELECT parent_key, coalesce(sub_display, display), key,
    CAST(row_number() OVER (PARTITION BY parent_key ORDER BY display, key) AS INTEGER) FROM catalogue WHERE is_sub"""))
def group_hierarchy(t):
    return hierarchy.positions_by_parent(hierarchy.catalogue(t.entries))


@query("resolve_parent", oracle(["entries"], [("fields", """SELECT concat(source, '_all') AS field FROM documents
    UNION SELECT concat(source, '_none') FROM documents""")], """SELECT field, coalesce(min(key), field) AS parent_key
    FROM fields LEFT JOIN (SELECT * FROM entries WHERE parent IS NULL) e ON occupation = field GROUP BY field"""))
def resolve_parent(t):
    fields = t.documents.select(F.explode(F.array(
        F.concat("source", F.lit("_all")), F.concat("source", F.lit("_none")))).alias("field")).distinct()
    return hierarchy.resolve_parent(t.entries, fields)


@query("input_profile", oracle(["postings"], [("counts", "SELECT category, count(*) AS n FROM postings GROUP BY 1")],
    """SELECT 'rows' AS metric, '' AS key, CAST(sum(n) AS DOUBLE) AS value FROM counts
    UNION ALL SELECT 'groups', '', CAST(count(category) AS DOUBLE) FROM counts
    UNION ALL SELECT * FROM (SELECT 'group_rows', category, CAST(n AS DOUBLE) FROM counts ORDER BY n DESC, category LIMIT 10)"""))
def input_profile(t):
    return hierarchy.postings_profile(t.postings)


@query("pairs_profile", oracle(["pairs"], [_VALID_PAIRS], """SELECT count(*) AS rows, min(ai_match_score) AS score_min,
    max(ai_match_score) AS score_max, round(avg(ai_match_score), 6) AS score_mean FROM valid_pairs"""))
def pairs_profile(t):
    out = hierarchy.pairs_profile(inputs.valid_pairs(t.pairs))
    return out.withColumn("score_mean", F.round("score_mean", 6))


@query("extraction_profile", postings_sql("""SELECT count(*) AS rows, min(len(skills)) AS items_min, max(len(skills)) AS items_max,
    round(avg(len(skills)), 6) AS items_mean, round(avg(CASE WHEN len(skills) = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_empty,
    round(avg(len(responsibilities)), 6) AS segments_mean FROM records"""))
def extraction_profile(t):
    out = hierarchy.extraction_profile(records(t))
    return out.select("rows", F.col("items_min").cast("long").alias("items_min"),
                      F.col("items_max").cast("long").alias("items_max"),
                      *[F.round(c, 6).alias(c) for c in ("items_mean", "share_empty", "segments_mean")])
