"""Language -> text map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

EMPTY = "map<string,string>"


def or_empty(m: Column) -> Column:
    return F.coalesce(m, F.create_map().cast(EMPTY))


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _zip(left: Column, right: Column, rule) -> Column:
    merged = F.map_zip_with(or_empty(left), or_empty(right), rule)
    return F.map_filter(merged, lambda _, v: v.isNotNull())


def upsert(old: Column, new: Column) -> Column:
    """Filled values overwrite, empty ones are ignored."""
    return _zip(old, new, lambda k, a, b: F.when(_filled(b), b).otherwise(a))


def update(old: Column, new: Column) -> Column:
    """Filled values overwrite; an empty value clears a language that exists."""
    return _zip(old, new, lambda k, a, b: F.when(b.isNull(), a).when(
        (b != "") | a.isNotNull(), b))


def prefer_right(left: Column, right: Column) -> Column:
    """The right side wins wherever it has the key, even when it is empty."""
    return _zip(left, right, lambda k, a, b: F.coalesce(b, a))


def fill_empty(old: Column, new: Column) -> Column:
    return _zip(old, new, lambda k, a, b: F.when(~_filled(a) & _filled(b), b).otherwise(
        F.when(a.isNotNull(), a)))


def missing_languages(targets: Column, languages: Column) -> Column:
    got = or_empty(targets)
    return F.filter(languages, lambda l: F.coalesce(F.element_at(got, l), F.lit("")) == "")


def differs(proposed: Column, library: Column) -> Column:
    """Some language has two filled values that differ after stripping."""
    lib = or_empty(library)
    return F.exists(F.map_entries(or_empty(proposed)), lambda e: (e["value"] != "") & F.coalesce(
        (F.element_at(lib, e["key"]) != "") & (strip(F.element_at(lib, e["key"])) != strip(e["value"])),
        F.lit(False)))


def uncertainty_note(proposed: Column, library: Column, merged: Column, languages: Column) -> Column:
    missing = missing_languages(merged, languages)
    return (F.when(F.size(missing) > 0, F.concat(F.lit("MISSING_TRANSLATIONS:"), F.array_join(missing, ",")))
            .when(differs(proposed, library), F.lit("TRANSLATION_DIFFERS")).otherwise(F.lit("")))


def resolve_target(targets: Column, lang: Column, source: Column, keep: Column) -> Column:
    """Value to show for a language: exact key (even empty), then the key in another case,
    then another variant of the same base language."""
    m = or_empty(targets)
    base = lambda c: F.substring_index(F.lower(c), "-", 1)
    pick = lambda test: F.get(F.filter(F.map_entries(m), lambda e: (e["value"] != "") & test(e["key"])), F.lit(0))["value"]
    return (F.when(keep, source)
            .when(F.map_contains_key(m, lang), F.element_at(m, lang))
            .otherwise(F.coalesce(pick(lambda k: F.lower(k) == F.lower(lang)),
                                  pick(lambda k: base(k) == base(lang)), F.lit(""))))


def clear_wrong_script(targets: Column, keep: Column) -> Column:
    from . import constants as K
    cleaned = F.transform_values(or_empty(targets), lambda l, v: F.when(
        ~l.isin(K.CJK_LANGUAGES) & v.rlike(K.HAN_CHAR), F.lit("")).otherwise(v))
    return F.when(keep, targets).otherwise(cleaned)


def backfill(targets: Column, languages: Column, source: Column, strategy: Column) -> Column:
    """Give every requested language the source term when it has no target yet."""
    fallback = F.map_from_arrays(languages, F.transform(languages, lambda _: source))
    return F.when(strategy == "skip", or_empty(targets)).otherwise(fill_empty(targets, fallback))


def has_translation_value(targets: Column, source: Column, strategy: Column) -> Column:
    src = F.lower(strip(source))
    return (strategy != "keep_original") | F.exists(
        F.map_values(or_empty(targets)), lambda v: (v != "") & (F.lower(strip(v)) != src))
