"""JSON of uncertain shape (H1, H2) and prompt texts (H3), on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom.functions.text import is_blank, strip

NONE = "(không có)"  # shown for an empty list
SECTIONS = ("experience", "projects", "education")
REVIEW_LISTS = ("strengths", "missing_skills", "cv_quality", "recommendations")


def _strings(*values) -> Column:
    return F.array(*values).cast("array<string>")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """Text of a value; true, false and null are spelled as in Python."""
    s = F.try_variant_get(v, "$", "string")
    return (F.when(_kind(v) == "VOID", "None").when(_kind(v) == "BOOLEAN", F.initcap(s))
            .otherwise(s))


def _truthy(v: Column) -> Column:
    s = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    kind = _kind(v)
    return (F.when(kind == "VOID", False).when(kind == "STRING", s != "")
            .when(kind == "BOOLEAN", s == "true")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~s.isin("[]", "{}"))
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def _is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def json_sections(c: Column, keys=SECTIONS) -> Column:
    """H1: struct of string lists; a string becomes one item, anything unusable an empty list."""
    parsed = F.when(_is_object(c), F.try_parse_json(c))

    def section(key):
        v = F.try_variant_get(parsed, f"$.{key}", "variant")
        kind = _kind(v)
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: strip(_text(x)))
        single = strip(F.try_variant_get(v, "$", "string"))
        return (F.when(kind.startswith("ARRAY"), F.filter(listed, lambda x: x != ""))
                .when((kind == "STRING") & (single != ""), _strings(single))
                .otherwise(_strings()))

    return F.struct(*[section(k).alias(k) for k in keys])


def _object_values(text: Column) -> Column:
    """Values of a JSON object in their written order (a VARIANT sorts its keys)."""
    values = F.map_values(F.from_json(text, "map<string,variant>"))
    return F.array_join(F.transform(F.filter(values, _truthy), _text), "; ")


def _string_list(v: Column, text: Column) -> Column:
    """List of strings from a string, or from a list of strings and objects."""
    kind = _kind(v)

    def element(x, raw):
        s = strip(F.try_variant_get(x, "$", "string"))
        return (F.when((_kind(x) == "STRING") & (s != ""), s)
                .when(_kind(x).startswith("OBJECT"), _object_values(raw)))

    listed = F.zip_with(F.try_variant_get(v, "$", "array<variant>"),
                        F.from_json(text, "array<string>"), element)
    single = F.try_variant_get(v, "$", "string")
    return (F.when(kind.startswith("ARRAY"), F.array_compact(listed))
            .when((kind == "STRING") & ~is_blank(single), _strings(single))
            .otherwise(_strings()))


def _first_truthy(parsed: Column, *keys: str) -> Column:
    values = [F.try_variant_get(parsed, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(_truthy(v), v) for v in values])


def _first_truthy_text(parsed: Column, raw: Column, *keys: str) -> Column:
    return F.coalesce(*[
        F.when(_truthy(F.try_variant_get(parsed, f"$.{k}", "variant")),
               F.get_json_object(raw, f"$.{k}")) for k in keys])


def _step(v: Column, raw: Column) -> Column:
    """One roadmap step from an object (with alternative key names) or from a string."""
    def named(*keys):
        return F.coalesce(strip(_text(_first_truthy(v, *keys))), F.lit(""))

    def whole(phase, focus, items):
        return F.struct(phase.alias("phase"), focus.alias("focus"), items.alias("items"))

    s = strip(F.try_variant_get(v, "$", "string"))
    named_or_empty = lambda *k: F.when(
        _first_truthy(v, *k).isNull(), F.lit("")).otherwise(named(*k))
    items = _string_list(_first_truthy(v, "items", "skills"),
                         _first_truthy_text(v, raw, "items", "skills"))
    return (F.when(_kind(v).startswith("OBJECT"),
                   whole(named_or_empty("phase", "giai_doan"),
                         named_or_empty("focus", "trong_tam"), items))
            .when((_kind(v) == "STRING") & (s != ""), whole(F.lit(""), s, _strings())))


def normalize_review(c: Column) -> Column:
    """H2: review JSON -> struct with the six fields, whatever shapes they came in."""
    parsed = F.when(_is_object(c), F.try_parse_json(c))

    def field(key):
        return F.try_variant_get(parsed, f"$.{key}", "variant")

    overall = field("overall_assessment")
    joined = F.array_join(
        F.transform(F.try_variant_get(overall, "$", "array<variant>"), _text), " ")
    assessment = F.when(_kind(overall).startswith("ARRAY"), joined).otherwise(
        F.try_variant_get(overall, "$", "string"))
    roadmap = field("learning_roadmap")
    steps = F.array_compact(F.zip_with(
        F.try_variant_get(roadmap, "$", "array<variant>"),
        F.from_json(F.get_json_object(c, "$.learning_roadmap"), "array<string>"), _step))
    no_steps = F.array().cast("array<struct<phase:string,focus:string,items:array<string>>>")
    return F.struct(
        F.coalesce(strip(assessment), F.lit("")).alias("overall_assessment"),
        *[_string_list(field(k), F.get_json_object(c, f"$.{k}")).alias(k) for k in REVIEW_LISTS],
        F.coalesce(F.when(_kind(roadmap).startswith("ARRAY"), steps), no_steps)
        .alias("learning_roadmap"))


# --- prompt texts --------------------------------------------------------------------------

def inline_list(items: Column, limit: int | None = None) -> Column:
    """Items in one line; beyond ``limit`` only their number."""
    n = F.size(items)
    if limit is None:
        return F.when(n <= 0, NONE).otherwise(F.array_join(items, ", "))
    rest = F.when(n > limit, F.concat(F.lit(" … (+"), (n - limit).cast("string"), F.lit(")"))) \
            .otherwise(F.lit(""))
    shown = F.concat(F.array_join(F.slice(items, 1, limit), ", "), rest)
    return F.when(n <= 0, NONE).otherwise(shown)


def bullet_list(items: Column, limit: int | None = None) -> Column:
    shown = F.transform(items if limit is None else F.slice(items, 1, limit), lambda x: F.concat(F.lit("  - "), x))
    return F.when(F.size(items) <= 0, "  " + NONE).otherwise(F.array_join(shown, "\n"))


def whole_percent(score: Column) -> Column:
    return F.bround(score * 100, 0).cast("int").cast("string")


INLINE = ("core_skills", "skills", "matched_skills", "missing_skills", "education")
BULLETS = ("experience", "projects")


def prompt_fields(df, limits: dict[str, int] | None = None):
    """H3: texts of a review request, one row per document, for any batch-inference job.

    Lists are whole unless ``limits`` has a number for them (`rules.PROMPT_LIMITS` for the usual one).
    """
    limits = limits or {}
    have = set(df.columns)
    return df.select(
        "doc_id", "target_key",
        *[whole_percent(F.col(c)).alias(c) for c in
          ("match_score", "semantic_similarity_score", "weighted_skill_score")],
        *[inline_list(F.col(c), limits.get(c)).alias(c) for c in INLINE if c in have],
        *[bullet_list(F.col(c), limits.get(c)).alias(c) for c in BULLETS if c in have])
