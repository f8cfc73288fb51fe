"""Item scalars: canonical spelling (B16), positions (B17), tiers (B19, B20), stop list."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitloom import rules
from fitloom.functions.arrays import let
from fitloom.functions.numbers import clamp01, round_half_even
from fitloom.functions.text import WS, strip


def constant_map(table: dict) -> Column:
    """Text lookup table as one constant, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _lookup(table: dict, key: Column) -> Column:
    """Value of a key. A map is searched entry by entry, so a set, which is hashed, tells first whether it has the key."""
    return F.when(key.isin(*table), constant_map(table)[key]) if table else F.lit(None).cast("string")


def collapse_suffix(c: Column, equivalent=None) -> Column:
    """Drop a repeated last token: ``REST API APIs`` -> ``REST API``."""
    equivalent = rules.SUFFIX_EQUIVALENT if equivalent is None else equivalent

    def same(token):
        low = F.lower(token)
        for a, b in equivalent.items():
            low = F.when(low == a, F.lit(b)).otherwise(low)
        return low

    def shorten(tokens, keys):
        last = F.element_at(keys, -1)
        differs = F.transform(keys, lambda k, i: F.when(k == last, 0).otherwise(i + 1))
        return F.array_join(F.slice(tokens, F.lit(1), F.array_max(differs) + 1), " ")

    kept = let(F.split(c, " "), lambda t: let(F.transform(t, same), lambda k: shorten(t, k)))
    # most names end in two different tokens; the list of tokens is only made for the others
    last, before = F.substring_index(c, " ", -1), F.substring_index(F.substring_index(c, " ", -2), " ", 1)
    return F.when(F.contains(c, F.lit(" ")) & (same(last) == same(before)), kept).otherwise(c)


def canonicalize(c: Column, alias=None, synonym=None, preferred=None) -> Column:
    """Alias -> synonym -> collapsed suffix -> alias -> synonym -> preferred spelling."""
    alias = rules.ALIAS_MAP if alias is None else alias
    synonym = rules.SYNONYM_MAP if synonym is None else synonym
    preferred = rules.PREFERRED_DISPLAY if preferred is None else preferred
    known = {**synonym, **alias}
    spelled = {**preferred, **known}

    def shortened(base):
        return let(collapse_suffix(base),
                   lambda short: F.coalesce(_lookup(spelled, F.lower(short)), short))

    # only a blank next to another one, or one that is no plain space, needs the replacement
    odd = F.regexp_like(c, F.lit(f"  |(?! ){WS}"))
    squeezed = F.when(odd, F.regexp_replace(strip(c), WS + "+", " ")).otherwise(strip(c))
    return let(squeezed, lambda base: F.coalesce(_lookup(known, F.lower(base)), shortened(base)))


def match_key(c: Column) -> Column:
    """Key under which a group item and a candidate item are the same."""
    return F.lower(strip(canonicalize(c)))


def is_stop_item(c: Column, stop_items=None) -> Column:
    """Item on the stop list, compared trimmed and in lower case."""
    stop_items = rules.STOP_ITEMS if stop_items is None else stop_items
    if not stop_items:
        return F.lit(False)
    return F.lower(strip(c)).isin(list(stop_items))


def item_tier(weight: Column) -> Column:
    """Tier of an item at match time."""
    return (F.when(weight >= rules.TIER_CORE, "core")
            .when(weight >= rules.TIER_IMPORTANT, "important")
            .otherwise("supporting"))


def score_percent(score: Column) -> Column:
    return round_half_even(clamp01(score) * 100, 1)


def verdict(percent: Column) -> Column:
    """Verdict label of a percentage."""
    good, partial, low = rules.VERDICT_LABELS
    return (F.when(percent >= rules.VERDICT_GOOD, good)
            .when(percent >= rules.VERDICT_PARTIAL, partial)
            .otherwise(low))


def assign_position(title: Column, parent: Column, taxonomy) -> Column:
    """First rule of the title's own field that matches; null when none does.

    ``taxonomy`` is an ordered list of ``(parent, key, display, [patterns])``.
    """
    chain = None
    for field, key, _display, patterns in taxonomy:
        regex = "(?iU)" + "|".join(f"(?:{p})" for p in patterns)
        hit = (parent == field) & F.regexp_like(title, F.lit(regex))
        chain = F.when(hit, key) if chain is None else chain.when(hit, key)
    return F.lit(None).cast("string") if chain is None else chain
