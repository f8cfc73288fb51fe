"""Text scalars (B1-B15): everything stays in the JVM except Unicode normalisation, which Spark
lacks.  The normalising Python functions only receive the rows that need them: all other rows
travel as nulls, so clean text never crosses the Arrow boundary.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitloom import rules
from fitloom.functions.arrays import let

# Python's notion of white space and of a word character, spelled out for Java regexes.
WS = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\x09-\x0d\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


# --- Unicode forms -------------------------------------------------------------------------

@lru_cache(maxsize=None)
def _unstable_chars() -> str:
    """Regex class of the characters that NFC may change or join to the one before them.

    Marks are one property; the others are the characters NFC itself changes, plus the Hangul
    vowels and finals.  Nothing below U+0300 is among them.
    """
    ranges: list[list[int]] = []
    for cp in range(0x300, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or unicodedata.category(ch)[0] == "M":
            continue
        if unicodedata.normalize("NFC", ch) != ch or 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2:
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return r"[\p{M}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@F.pandas_udf(T.StringType())
def _to_nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    def plain(v):
        return "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
    return values.map(plain, na_action="ignore")


def nfc(c: Column) -> Column:
    """B1: Unicode NFC."""
    high = F.regexp_like(c, F.lit(r"[^\x00-\x{2ff}]"))
    unstable = F.when(high & F.regexp_like(c, F.lit(_unstable_chars())), c)
    return F.coalesce(_to_nfc(unstable), c)


def without_marks(c: Column) -> Column:
    """NFKD with the combining marks dropped (``đ`` has no decomposition and stays)."""
    unstable = F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7f]")), c)
    return F.coalesce(_without_marks(unstable), c)


# --- cleaning steps ------------------------------------------------------------------------

def strip_html(c: Column) -> Column:
    """B2: each tag becomes one space.

    No tag can end after the last ``>``.  The rest of the text is left out of the search, where
    every ``<`` would otherwise be followed to the end of the text.
    """
    tail = F.substring_index(c, ">", -1)
    head = F.left(c, F.length(c) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"<[^>]+>", " "), tail)


def strip_urls(c: Column) -> Column:
    """URLs, then e-mail addresses, become one space.

    An address always spans a whole run of non-space characters, so the search is anchored at
    the start of a run: a long run without ``@`` is scanned once instead of once per character.
    """
    c = F.regexp_replace(c, rf"https?://{NOT_WS}+|www\.{NOT_WS}+", " ")
    return F.regexp_replace(c, rf"(?<!{NOT_WS}){NOT_WS}+@{NOT_WS}+\.{NOT_WS}+", " ")


def strip_special(c: Column) -> Column:
    """Keep word characters, white space and the technical punctuation."""
    return F.regexp_replace(
        c, r"[^\p{L}\p{N}_\x09-\x0d\x1c-\x1f\x85\p{Z}+#/.\-,;:!?()\[\]]", " ")


def normalize_ws(c: Column) -> Column:
    """Squeeze blanks, keep at most one empty line, trim."""
    c = F.regexp_replace(c, r"[\t\r\f\x0b]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r" {2,}", " "))


# --- ordered regex rules -------------------------------------------------------------------

def fold(c: Column) -> Column:
    """Lower case under which every case-insensitive regex match also matches literally."""
    return F.lower(F.translate(c, "İıſK", "iisk"))


def _closing(pattern: str, i: int) -> int:
    """Place of the bracket that closes the one at ``i``."""
    if pattern[i] == "[":
        i += 2 if pattern[i + 1:i + 2] == "^" else 1
        i += pattern[i:i + 1] == "]"  # a first bracket is a member
        while pattern[i] != "]":
            i += 2 if pattern[i] == "\\" else 1
        return i
    i += 1
    while pattern[i] != ")":
        i = _closing(pattern, i) if pattern[i] in "[(" else i + (pattern[i] == "\\")
        i += 1
    return i


def required_literal(pattern: str) -> str:
    """Longest run of plain characters that any match of ``pattern`` has to contain.

    Groups, classes and whatever else is not plain end a run; with alternatives at the top there is
    none, and the empty literal lets every text pass.
    """
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "*?{+":
            # what stands before may be missing, unless it is repeated by "+"
            runs.append(run if c == "+" else run[:-1])
            run = ""
            i = pattern.index("}", i) if c == "{" else i
            i += pattern[i + 1:i + 2] in ("?", "+")
        elif c == "\\" and pattern[i + 1] not in "bBAZz":
            i += 1
            if pattern[i].isalnum():
                runs.append(run)
                run = ""
            else:
                run += pattern[i]
        elif c in "[(.":
            runs.append(run)
            run = ""
            i = i if c == "." else _closing(pattern, i)
        elif c == "\\":
            i += 1  # a border
        elif c not in "^$":
            run += c
        i += 1
    return max(runs + [run], key=len).lower()


def java_pattern(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of a rule for Java's regex engine."""
    return "(?iU)" + pattern


def rule_table(pairs, schema: str) -> Column:
    """Rules as one constant array of structs (folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(pairs)), f"array<struct<{schema}>>")


def rewrite_aliases(c: Column, alias_rules=None) -> Column:
    """Apply the rules one after the other.

    The text carries its folded form along; a rule's regex runs only if the folded text has the
    literal part of the rule, which a byte search answers much faster than the regex does.
    """
    alias_rules = rules.ALIAS_RULES if alias_rules is None else alias_rules
    table = rule_table(
        [{"lit": required_literal(p), "pat": java_pattern(p),
          "rep": r.replace("\\", "\\\\").replace("$", "\\$")} for p, r in alias_rules],
        "lit string, pat string, rep string")

    def state(text):
        return F.struct(text.alias("text"), fold(text).alias("folded"))

    def step(acc, rule):
        hit = F.contains(acc["folded"], rule["lit"])
        changed = F.regexp_replace(acc["text"], rule["pat"], rule["rep"])
        return F.when(hit, let(changed, state)).otherwise(acc)

    return F.aggregate(table, let(c, state), step, lambda acc: acc["text"])


def _clean_native(c: Column, alias_rules) -> Column:
    c = rewrite_aliases(strip_urls(strip_html(c)), alias_rules)
    return normalize_ws(strip_special(c))


def clean_text(c: Column, alias_rules=None) -> Column:
    """The whole cleaning chain; null and blank become ''."""
    return F.when(is_blank(c), F.lit("")).otherwise(_clean_native(nfc(c), alias_rules))


# --- list literals -------------------------------------------------------------------------

def _literal_items(text: str, normalize: bool):
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    if not isinstance(value, list):
        return None
    items = [str(v).strip() for v in value]
    items = [unicodedata.normalize("NFC", v) for v in items] if normalize else items
    return [v for v in items if v]


def _literal_udf(normalize: bool):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parse(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _literal_items(v, normalize), na_action="ignore")
    return parse


def parse_list(c: Column, normalize: bool = False) -> Column:
    """List literal -> trimmed non-empty items; other text -> itself; blank -> [].

    Lists of plainly quoted strings (what nearly every row holds) are parsed by ``from_json``.
    Only text with a bracket that is not of that shape (escapes, numbers, nesting, mistakes)
    goes to the exact Python literal parser.
    """
    body = strip(c)
    outside = F.regexp_replace(body, r"'[^'\\\n\r]*'|\"[^\"\\\n\r]*\"", "")
    simple = F.regexp_like(outside, F.lit(r"^\[[ ,]*\]$"))
    native = F.when(simple, F.from_json(
        body, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}))
    odd = F.when(native.isNull() & F.contains(c, F.lit("[")) & ~is_blank(c), c)
    parsed = F.coalesce(native, _literal_udf(normalize)(odd), F.array(body))
    items = F.filter(F.transform(parsed, strip), lambda x: x != "")
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(items)


def clean_list(c: Column, alias_rules=None) -> Column:
    """Parse, clean every item, drop the empty ones."""
    items = parse_list(nfc(c), normalize=True)
    cleaned = F.transform(items, lambda x: _clean_native(x, alias_rules))
    return F.filter(cleaned, lambda x: x != "")


# --- names and keys ------------------------------------------------------------------------

def truncate(c: Column, n: int) -> Column:
    """First ``n`` code points."""
    return F.substring(c, 1, n)


def group_key(c: Column) -> Column:
    """Stable key of a group label."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def display_name(c: Column) -> Column:
    """Readable label of a key."""
    name = strip(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.when(name == "", c).otherwise(capitalize_first(name))


def slug(c: Column) -> Column:
    """Name that is safe in a file path."""
    safe = F.regexp_replace(F.lower(without_marks(c)), NOT_WORD, "_")
    return F.btrim(F.regexp_replace(safe, r"_+", "_"), F.lit("_"))
