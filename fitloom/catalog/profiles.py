"""Queries over baskets: counting, weighting, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.catalog.base import Inputs, oracle, query, rounded
from fitloom.functions.items import canonicalize
from fitloom.functions.numbers import minmax
from fitloom.operators import hierarchy, profile, variants
from fitloom.plans.materialize import cut

ORDER = ("pos", "sub_pos")
KEY = "replace(lower(trim(grp)), ' ', '_')"


# --- Spark side ----------------------------------------------------------------------------

def basket_rows(t: Inputs, view: str = "baskets") -> DataFrame:
    return profile.known_groups(t.view(view), "grp")


def parts(t: Inputs, view: str = "baskets", first_seen: bool = False):
    """(sizes, kept): group sizes and supported items."""
    rows = basket_rows(t, view)
    sizes = cut(profile.group_sizes(rows, "grp", distinct_rows=True))
    support = profile.item_support(profile.item_rows_from_long(rows, ORDER), first_seen=first_seen)
    return sizes, cut(profile.minimum_support(support, sizes))


def weights(t: Inputs, view: str = "baskets") -> DataFrame:
    sizes, kept = parts(t, view)
    return profile.item_weights(profile.scored_items(profile.item_frequency(kept), sizes))


def entries(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat(
        s["item"], F.lit("="), F.format_string("%.4f", s["weight"]))), "|")


# --- checking SQL --------------------------------------------------------------------------

def ctes(view: str = "baskets"):
    return [
        ("ranked", f"""SELECT {KEY} AS occ_key, grp, row_id, pos, sub_pos, trim(item) AS item,
            row_number() OVER (PARTITION BY row_id, lower(trim(item)) ORDER BY pos, sub_pos, trim(item)) AS rn
            FROM {view} WHERE grp IS NOT NULL AND grp NOT IN ('', 'unknown') AND length(trim(item)) >= 2"""),
        ("first_rows", "SELECT * FROM ranked WHERE rn = 1"),
        ("support", """SELECT occ_key, item, count(*) AS count,
            min(row_id * 1000000000 + pos * 100000000 + sub_pos) AS seen
            FROM first_rows GROUP BY occ_key, item"""),
        ("sizes", f"""SELECT {KEY} AS occ_key, count(DISTINCT row_id) AS jd_count,
            arg_max(grp, row_id) AS occupation FROM {view} GROUP BY 1"""),
        ("kept", """SELECT s.*, jd_count FROM support s JOIN sizes USING (occ_key)
            WHERE count >= greatest(2, CAST(floor(jd_count * 0.01) AS BIGINT))"""),
        ("freq", f"SELECT *, {rounded('count / jd_count', 6)} AS frequency FROM kept"),
        ("dfs", "SELECT lower(item) AS low, count(DISTINCT occ_key) AS df FROM kept GROUP BY 1"),
        ("raws", """SELECT f.*, df, frequency * ln(1 + (SELECT count(*) FROM sizes) / (1 + df)) AS raw
            FROM freq f JOIN dfs ON lower(f.item) = low"""),
        ("spans", """SELECT *, min(raw) OVER g AS r0, max(raw) OVER g AS r1,
            min(frequency) OVER g AS f0, max(frequency) OVER g AS f1
            FROM raws WINDOW g AS (PARTITION BY occ_key)"""),
        ("scored_items", f"""SELECT *,
            CASE WHEN r1 = r0 THEN 0.5 ELSE {rounded('(raw - r0) / nullif(r1 - r0, 0)', 6)} END AS tfidf,
            CASE WHEN f1 = f0 THEN 0.5 ELSE {rounded('(frequency - f0) / nullif(f1 - f0, 0)', 6)} END AS freq_norm
            FROM spans"""),
        ("blended", f"SELECT *, {rounded('0.8::DOUBLE * freq_norm + 0.2::DOUBLE * tfidf', 4)} AS weight FROM scored_items"),
        ("weights", "SELECT *, CASE WHEN weight >= 0.35 THEN 'core' ELSE 'optional' END AS tier FROM blended"),
    ]


def sql(select: str, view: str = "baskets", extra=()) -> str:
    return oracle([view], [*ctes(view), *extra], select)


def _values(table: dict) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


# --- D1-D3, D5, D6 -------------------------------------------------------------------------

@query("item_support", sql("SELECT occ_key, item, count FROM support", "baskets_var"))
def item_support(t):
    return profile.item_support(
        profile.item_rows_from_long(basket_rows(t, "baskets_var"), ORDER))


@query("item_support_folded", sql("""SELECT occ_key, arg_min(item, row_id * 1000000000 + pos * 100000000
    + sub_pos) AS item, count(*) AS count FROM first_rows GROUP BY occ_key, lower(item)""", "baskets_var"))
def item_support_folded(t):
    return profile.item_support(
        profile.item_rows_from_long(basket_rows(t, "baskets_var"), ORDER), fold_case=True)


@query("min_support", sql("SELECT occ_key, item, count, jd_count FROM kept"))
def min_support(t):
    return parts(t)[1].select("occ_key", "item", "count", "jd_count")


@query("group_sizes", sql("SELECT occ_key, jd_count, occupation FROM sizes"))
def group_sizes(t):
    return profile.group_sizes(basket_rows(t), "grp", distinct_rows=True)


_ASSEMBLED = ("assembled", """SELECT occ_key, count(*) AS n_skills,
    string_agg(concat(item, '=', count), '|' ORDER BY count DESC, seen) AS skills,
    list(item ORDER BY count DESC, seen) AS items FROM kept GROUP BY occ_key""")


@query("profile_assemble", sql("""SELECT s.occ_key, occupation, jd_count,
    coalesce(n_skills, 0) AS n_skills, coalesce(skills, '') AS skills
    FROM sizes s LEFT JOIN assembled USING (occ_key)""", extra=[_ASSEMBLED]))
def profile_assemble(t):
    sizes, kept = parts(t, first_seen=True)
    nested = profile.assemble_profiles(kept, sizes)
    listed = F.transform("skill_counts", lambda s: F.concat(s["item"], F.lit("="), s["count"].cast("string")))
    return nested.select("occ_key", "occupation", "jd_count",
                         F.size("skills").cast("long").alias("n_skills"),
                         F.array_join(listed, "|").alias("skills"))


@query("profile_summary", sql("""SELECT s.occ_key, occupation, jd_count,
    coalesce(n_skills, 0) AS unique_skills, CAST(0 AS BIGINT) AS responsibility_count,
    coalesce(array_to_string(items[1:5], ', '), '') AS top_5_skills
    FROM sizes s LEFT JOIN assembled USING (occ_key)""", extra=[_ASSEMBLED]))
def profile_summary(t):
    sizes, kept = parts(t, first_seen=True)
    out = profile.profile_summary(profile.assemble_profiles(kept, sizes))
    return out.withColumns({c: F.col(c).cast("long") for c in ("unique_skills", "responsibility_count")})


# --- D7-D15, D27 ---------------------------------------------------------------------------

@query("item_frequency", sql("SELECT occ_key, item, count, frequency FROM freq"))
def item_frequency(t):
    return profile.item_frequency(parts(t)[1]).select("occ_key", "item", "count", "frequency")


def _top(column, table):
    return f"""SELECT occ_key, item, {column}, rank FROM (SELECT *, row_number() OVER (
        PARTITION BY occ_key ORDER BY {column} DESC, item) AS rank FROM {table}) WHERE rank <= 20"""


@query("topk_frequency", sql(_top("frequency", "freq")))
def topk_frequency(t):
    return profile.top_items(profile.item_frequency(parts(t)[1]), "frequency").select(
        "occ_key", "item", "frequency", F.col("rank").cast("long").alias("rank"))


@query("frequency_stats", sql(f"""SELECT occ_key, count(*) AS skill_count,
    {rounded('max(frequency)', 4)} AS max_frequency, {rounded('min(frequency)', 4)} AS min_frequency,
    {rounded('avg(frequency)', 4)} AS mean_frequency FROM freq GROUP BY occ_key"""))
def frequency_stats(t):
    return profile.frequency_stats(profile.item_frequency(parts(t)[1]))


@query("doc_frequency", sql("SELECT low, df FROM dfs", "baskets_var"))
def doc_frequency(t):
    return profile.document_frequency(parts(t, "baskets_var")[1])


@query("first_spelling", sql("""SELECT low, item AS spelling FROM (SELECT *, lower(item) AS low, row_number()
    OVER (PARTITION BY lower(item) ORDER BY occ_key, count DESC, seen) AS rn FROM kept) WHERE rn = 1""",
    "baskets_var"))
def first_spelling(t):
    return profile.first_spelling(parts(t, "baskets_var", first_seen=True)[1])


@query("tfidf", sql("SELECT occ_key, item, tfidf FROM scored_items", "baskets_var"))
def tfidf(t):
    sizes, kept = parts(t, "baskets_var")
    return profile.scored_items(profile.item_frequency(kept), sizes).select("occ_key", "item", "tfidf")


@query("topk_tfidf", sql(_top("tfidf", "scored_items")))
def topk_tfidf(t):
    return profile.top_items(weights(t), "tfidf").select(
        "occ_key", "item", "tfidf", F.col("rank").cast("long").alias("rank"))


_ACROSS = ("across", """SELECT low, occ_key, tfidf FROM (SELECT *, lower(item) AS low, row_number() OVER (
    PARTITION BY lower(item), occ_key ORDER BY count DESC, item) AS rn FROM scored_items) WHERE rn = 1""")


@query("item_across_groups", sql("SELECT * FROM across", "baskets_var", [_ACROSS]))
def item_across_groups(t):
    return profile.item_across_groups(weights(t, "baskets_var"))


@query("item_spread", sql("""SELECT low, arg_min(occ_key, rb) AS top_group, max(tfidf) AS top_score,
    arg_max(occ_key, rb) AS bottom_group, min(tfidf) AS bottom_score,
    round(max(tfidf) - min(tfidf), 6) AS spread
    FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY tfidf DESC, occ_key) AS rb FROM across)
    GROUP BY low""", "baskets_var", [_ACROSS]))
def item_spread(t):
    out = profile.item_spread(profile.item_across_groups(weights(t, "baskets_var")))
    return out.withColumn("spread", F.round("spread", 6))


@query("minmax", f"""SELECT method, event_id, CASE WHEN hi = lo THEN 0.5
    ELSE {rounded('(pred - lo) / nullif(hi - lo, 0)', 6)} END AS scaled
    FROM (SELECT event_type AS method, event_id, value / 500.0 AS pred,
    min(value / 500.0) OVER (PARTITION BY event_type) AS lo,
    max(value / 500.0) OVER (PARTITION BY event_type) AS hi FROM events)""")
def minmax_query(t):
    rows = t.scored
    span = rows.groupBy("method").agg(F.min("pred").alias("lo"), F.max("pred").alias("hi"))
    return rows.join(span, "method").select(
        "method", "event_id", minmax(F.col("pred"), F.col("lo"), F.col("hi")).alias("scaled"))


@query("compare_rankings", sql(f"""SELECT coalesce(f.occ_key, t.occ_key) AS occ_key,
    coalesce(f.item, t.item) AS item, coalesce(frequency, 0) AS frequency, coalesce(tfidf, 0) AS tfidf
    FROM ({_top('frequency', 'scored_items')}) f
    FULL JOIN ({_top('tfidf', 'scored_items')}) t ON f.occ_key = t.occ_key AND f.item = t.item"""))
def compare_rankings(t):
    return profile.compare_rankings(weights(t))


# --- D16-D18, D25 --------------------------------------------------------------------------

@query("item_weights", sql("SELECT occ_key, item, weight, tier FROM weights"))
def item_weights(t):
    return weights(t).select("occ_key", "item", "weight", "tier")


@query("combined_weights", sql(f"""SELECT coalesce(f.occ_key, t.occ_key) AS occ_key,
    coalesce(f.item, t.item) AS item, {rounded('0.8::DOUBLE * coalesce(freq_norm, 0) + 0.2::DOUBLE * coalesce(tfidf, 0)', 4)} AS weight
    FROM (SELECT occ_key, CASE WHEN df < 20 THEN item ELSE concat(item, ' *') END AS item, freq_norm FROM scored_items) f
    FULL JOIN (SELECT occ_key, CASE WHEN df > 8 THEN item ELSE concat(item, ' +') END AS item, tfidf FROM scored_items) t
    ON f.occ_key = t.occ_key AND f.item = t.item"""))
def combined_weights(t):
    scored = weights(t)
    # items that one side has under a name of its own are missing on the other
    freq = scored.selectExpr("occ_key", "if(df < 20, item, concat(item, ' *')) AS item", "freq_norm")
    spec = scored.selectExpr("occ_key", "if(df > 8, item, concat(item, ' +')) AS item", "tfidf")
    return profile.combine_weights(freq, spec).select("occ_key", "item", "weight")


_NESTED = ("nested", """SELECT occ_key,
    coalesce(string_agg(concat(item, '=', format('{:.4f}', weight)), '|' ORDER BY weight DESC, item)
        FILTER (tier = 'core'), '') AS core_skills,
    coalesce(string_agg(concat(item, '=', format('{:.4f}', weight)), '|' ORDER BY weight DESC, item)
        FILTER (tier = 'optional'), '') AS optional_skills
    FROM weights GROUP BY occ_key""")


@query("core_optional", sql("SELECT * FROM nested", extra=[_NESTED]))
def core_optional(t):
    return profile.nest_weights(weights(t)).select(
        "occ_key", entries("core_skills").alias("core_skills"),
        entries("optional_skills").alias("optional_skills"))


_COUNTS = """SELECT s.occ_key, jd_count, count(*) FILTER (tier = 'core') AS n_core,
    count(*) FILTER (tier = 'optional') AS n_optional
    FROM sizes s LEFT JOIN weights w USING (occ_key) GROUP BY ALL"""


@query("kb_summary", sql(f"""SELECT occ_key, CAST(sum(n_core) AS BIGINT) AS n_core,
    CAST(sum(n_optional) AS BIGINT) AS n_optional, CAST(sum(jd_count) AS BIGINT) AS jd_count,
    sum(n_core) / greatest(sum(n_core) + sum(n_optional), 1) AS core_share
    FROM ({_COUNTS.replace('jd_count,', 's.jd_count,', 1)}) GROUP BY ROLLUP (occ_key)"""))
def kb_summary(t):
    sizes, kept = parts(t)
    w = profile.item_weights(profile.scored_items(profile.item_frequency(kept), sizes))
    return hierarchy.store_summary(w, sizes)


# --- D19-D22 -------------------------------------------------------------------------------

# extra preferred spellings, so that the fixed table has something to decide
PREFERRED = {**rules.PREFERRED_DISPLAY, "red plate": "RED Plate", "hot ring": "hOT ring"}

_PREFERENCE = [
    ("seen_once", """SELECT occ_key, lower(item) AS low, item AS canon, weight, tier, row_number() OVER (
        PARTITION BY occ_key, lower(item) ORDER BY weight DESC, item) AS rn FROM weights"""),
    ("variant_counts", "SELECT low, canon, count(*) AS n FROM seen_once WHERE rn = 1 GROUP BY low, canon"),
    ("best", """SELECT low, canon FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC,
        CASE WHEN substr(canon, 1, 1) = upper(substr(canon, 1, 1)) THEN 0 ELSE 1 END, canon) AS rn
        FROM variant_counts) WHERE rn = 1"""),
    ("preference", f"""SELECT b.low, coalesce(p.display, b.canon) AS display FROM best b
        LEFT JOIN {_values(PREFERRED)} p(low, display) ON b.low = p.low"""),
]

# the canonical form of the two extra spellings is the preferred one itself
_CANON = [("canonical", f"""SELECT w.* REPLACE (coalesce(p.display, w.item) AS item) FROM weights w
    LEFT JOIN {_values(PREFERRED)} p(low, display) ON lower(w.item) = p.low""")]


def _variant_sql(select, extra=()):
    pref = [(n, b.replace("FROM weights", "FROM canonical")) for n, b in _PREFERENCE]
    return sql(select, "baskets_var", [*_CANON, *pref, *extra])


def _variant_weights(t):
    return variants.with_canonical(weights(t, "baskets_var"), PREFERRED)


@query("display_preference", _variant_sql("SELECT low, display FROM preference"))
def display_preference(t):
    return variants.display_preference(_variant_weights(t), PREFERRED, order=_by_weight())


def _by_weight():
    return (-F.col("weight"), "canon")


def _merged(agg):
    return _variant_sql(f"""SELECT occ_key, display AS item, round({agg}, 6) AS weight FROM canonical c
        JOIN preference p ON lower(c.item) = p.low GROUP BY occ_key, display""")


def _dedupe(t, merge):
    rows = _variant_weights(t)
    pref = variants.display_preference(rows, PREFERRED, order=_by_weight())
    return variants.dedupe_weighted(rows, pref, merge).withColumn("weight", F.round("weight", 6))


@query("dedupe_weighted", _merged("max(weight)"))
def dedupe_weighted(t):
    return _dedupe(t, "max")


@query("dedupe_weighted_sum", _merged("greatest(0.0, least(1.0, sum(weight)))"))
def dedupe_weighted_sum(t):
    return _dedupe(t, "sum")


@query("dedupe_list", oracle(["baskets_var"], [
    ("numbered", """SELECT row_id, item, row_number() OVER (PARTITION BY row_id ORDER BY pos, sub_pos, item) AS i
        FROM baskets_var"""),
    ("firsts", """SELECT row_id, min(i) AS i, arg_min(item, i) AS item FROM numbered
        GROUP BY row_id, lower(item)""")],
    "SELECT row_id, string_agg(item, '|' ORDER BY i) AS items FROM firsts GROUP BY row_id"))
def dedupe_list(t):
    lists = t.baskets_var.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "sub_pos", "item"))).alias("s"))
    plain = F.transform("s", lambda s: s["item"])
    return lists.select("row_id", plain.alias("items")).select(
        "row_id", F.array_join(variants.dedupe_list(F.col("items")), "|").alias("items"))


_CLEANED = [("by_tier", """SELECT occ_key, tier, display AS item, max(weight) AS weight FROM canonical c
        JOIN preference p ON lower(c.item) = p.low GROUP BY occ_key, tier, display"""),
    ("cleaned", """SELECT occ_key, item, weight, tier FROM by_tier b WHERE tier = 'core' OR NOT EXISTS (
        SELECT 1 FROM by_tier c WHERE c.occ_key = b.occ_key AND c.tier = 'core' AND lower(c.item) = lower(b.item))""")]


@query("clean_profiles", _variant_sql("SELECT * FROM cleaned", _CLEANED))
def clean_profiles(t):
    return variants.clean_weighted_profiles(
        weights(t, "baskets_var").select("occ_key", "item", "weight", "tier"), PREFERRED)


@query("clean_profile_stats", _variant_sql("""SELECT b.occ_key, core_before, opt_before,
    coalesce(core_after, 0) AS core_after, coalesce(opt_after, 0) AS opt_after
    FROM (SELECT occ_key, count(*) FILTER (tier = 'core') AS core_before,
          count(*) FILTER (tier = 'optional') AS opt_before FROM weights GROUP BY 1) b
    LEFT JOIN (SELECT occ_key, count(*) FILTER (tier = 'core') AS core_after,
          count(*) FILTER (tier = 'optional') AS opt_after FROM cleaned GROUP BY 1) USING (occ_key)""",
    _CLEANED))
def clean_profile_stats(t):
    before = weights(t, "baskets_var").select("occ_key", "item", "weight", "tier")
    return variants.cleaning_stats(before, variants.clean_weighted_profiles(before, PREFERRED))


@query("canonicalize", oracle(["baskets_var"], [("names", "SELECT DISTINCT item FROM baskets_var"),
    ("texts", """SELECT DISTINCT concat(' ', item, '  ', word) AS item FROM names,
        (VALUES ('APIs'), ('api apis'), ('api')) w(word) UNION ALL SELECT item FROM names
        UNION ALL SELECT concat(event_type, ' js') FROM events GROUP BY event_type""")],
    f"""SELECT item, CASE WHEN regexp_matches(s, '(?i) api(s?)( apis?)*$')
        THEN concat(regexp_replace(s, '(?i)( apis?)+$', ''), ' ', regexp_extract(s, '(?i) (apis?)( apis?)*$', 1))
        ELSE coalesce(p.display, s) END AS canonical
    FROM (SELECT item, regexp_replace(trim(item), '\\s+', ' ', 'g') AS s FROM texts) t
    LEFT JOIN {_values(PREFERRED)} p(low, display) ON lower(s) = p.low"""))
def canonicalize_query(t):
    names = t.baskets_var.select("item").distinct()
    suffixed = names.select(F.explode(F.transform(
        F.lit(["APIs", "api apis", "api"]), lambda w: F.concat(F.lit(" "), "item", F.lit("  "), w))).alias("item"))
    events = t.events.select(F.concat("event_type", F.lit(" js")).alias("item")).distinct()
    return names.union(suffixed).union(events).select(
        "item", canonicalize(F.col("item"), preferred=PREFERRED).alias("canonical"))
