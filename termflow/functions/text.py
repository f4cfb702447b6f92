"""Text column expressions. All but the two that count words stay inside the JVM."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def let(value: Column, fn) -> Column:
    """fn(value) with the value worked out once per row. A plain column expression used inside a
    lambda would be worked out again for every array element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(K.WHITESPACE))


def normalize_term(c: Column) -> Column:
    return F.lower(strip(c))


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n")


def file_lines(c: Column) -> Column:
    """Lines of a file: no byte-order mark and no empty line after a final newline."""
    text = F.regexp_replace(c, r"^\x{feff}", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.WORD)).cast("bigint")


def token_tenths(c: Column) -> Column:
    """Token estimate in tenths: 5 per wide character, 13 per remaining word.

    Whole numbers keep budget comparisons exact whatever the order of summation.
    """
    wide = F.regexp_count(c, F.lit(K.WIDE_CHAR))
    words = F.regexp_count(F.regexp_replace(c, K.WIDE_CHAR, ""), F.lit(K.WORD))
    return (wide * 5 + words * 13).cast("bigint")


def token_estimate(c: Column) -> Column:
    return token_tenths(c) / 10.0


def ends_sentence(c: Column) -> Column:
    return c.rlike(K.SENTENCE_END)


def has_han(c: Column) -> Column:
    return c.rlike(K.HAN_CHAR)


def is_translatable(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) >= 2) & ~t.rlike(K.URL_ONLY) & ~t.rlike(K.NUMBER_ONLY)


def looks_like_code(key_path: Column, value: Column) -> Column:
    last = F.lower(F.regexp_extract(key_path, r"[^.]*$", 0))
    identifier = value.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & (F.length(value) < 30)
    return last.isin(K.JSON_SKIP_KEYS) | identifier


def clock_seconds(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, K.CLOCK, i)
    millis = F.rpad(F.substring(part(4), 1, 3), 3, "0").cast("double")
    total = (part(1).cast("double") * 3600 + part(2).cast("double") * 60
             + part(3).cast("double") + millis / 1000)
    return F.when(c.rlike(K.CLOCK), total)


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(K.PLACEHOLDER), F.lit(0))


def strip_line_ends(c: Column) -> Column:
    cut = lambda line: F.regexp_replace(line, K.TRAILING_PUNCT, "")
    return F.array_join(
        F.transform(F.split(c, "\n"), lambda x: F.when(cut(x) == "", x).otherwise(cut(x))), "\n")


def flatten(c: Column) -> Column:
    one_line = F.regexp_replace(c, r"\r\n|\r|\n", " ")
    return strip(F.regexp_replace(one_line, " {2,}", " "))


def best_text(reviewed: Column, translated: Column, source: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(reviewed, blank), F.nullif(translated, blank), source)


def paragraph_text(reviewed: Column, translated: Column, source: Column, prefix: Column) -> Column:
    """Single-line output text with its list prefix put back once."""
    flat = flatten(best_text(strip(reviewed), strip(translated), source))
    p = F.coalesce(prefix, F.lit(""))
    return F.when((p != "") & (flat != "") & ~F.startswith(flat, p),
                  F.concat(p, flat)).otherwise(flat)


def list_prefix(c: Column) -> Column:
    return F.when(c.rlike(K.NUMBER_PREFIX), F.regexp_extract(c, K.NUMBER_PREFIX, 1)).otherwise(
        F.regexp_extract(c, K.BULLET_PREFIX, 1))


def list_content(c: Column) -> Column:
    return (F.when(c.rlike(K.NUMBER_PREFIX), strip(F.regexp_extract(c, K.NUMBER_PREFIX, 2)))
            .when(c.rlike(K.BULLET_PREFIX), strip(F.regexp_extract(c, K.BULLET_PREFIX, 2)))
            .otherwise(c))


def expansion_ratio(source: Column, translated: Column) -> Column:
    return F.when(F.length(source) > 0, F.length(translated) / F.length(source))


def fitted_font_size(size: Column, ratio: Column) -> Column:
    return F.when(ratio > K.FONT_RATIO, F.greatest(F.lit(K.FONT_FLOOR), size / ratio)).otherwise(size)


def count_occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term; both sides already lower-case."""
    cut = F.replace(text, term, F.lit(""))
    return F.when(term == "", F.lit(0)).otherwise(
        ((F.length(text) - F.length(cut)) / F.length(term))).cast("bigint")


def quoted(c: Column) -> Column:
    """Regex-quote a column so it matches literally."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-&#~])", r"\\$1")


def spaced(c: Column) -> Column:
    """Lower-case text in which every symbol stands alone between spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ ]", " $0 "), F.lit(" "))


def term_in_text(term: Column, text: Column) -> Column:
    """ASCII terms need word boundaries, other terms match anywhere; case is ignored.

    Terms that start and end with a word character are compared in spaced form, which needs no
    pattern per row; only terms edged by symbols use a pattern of their own.
    """
    ascii_only = term.rlike(r"^[\x{00}-\x{7f}]*$")
    word_edges = term.rlike(r"^\w(.*\w)?$")
    pattern = F.concat(F.lit(r"(?i)(?U)\b"), quoted(term), F.lit(r"\b"))
    return (F.length(term) > 0) & (
        F.when(~ascii_only, F.contains(F.lower(text), F.lower(term)))
        .when(word_edges, F.contains(spaced(text), spaced(term)))
        .otherwise(F.regexp_like(text, pattern)))


def normalize_domain(raw: Column, synonyms: dict[str, str] = K.DOMAIN_SYNONYMS) -> Column:
    key = F.regexp_replace(F.lower(strip(raw)), "[ -]", "_")
    pairs = [F.lit(x) for pair in synonyms.items() for x in pair]
    return F.when(key.isin(K.DOMAINS), key).otherwise(
        F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit("general")))


def language_name(code: Column) -> Column:
    pairs = [F.lit(x) for kv in K.LANGUAGE_NAMES_EN.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(code)), code)


def canonical_language(code: Column) -> Column:
    return (F.when(strip(F.coalesce(code, F.lit(""))) == "", "en")
            .when(code.isin("zh", "zh-cn"), "zh-CN").when(code == "zh-tw", "zh-TW").otherwise(code))


def request_key(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]+$", 0))


def output_name(path: Column, lang: Column) -> Column:
    """`{stem}_{lang}{suffix}`"""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    suffix = F.regexp_extract(name, r"(?<=.)\.[^.]+$", 0)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.concat(stem, F.lit("_"), lang, suffix)


WORD = re.compile("[a-z]{3,}")
FEW_CHARACTERS = 1 << 19


def words_by_count(texts: Column | str, least: int = 1) -> Column:
    """Words of three letters or more of an array of lower-case texts, with their frequency, the most
    frequent first, then by the word; those below `least` are left out."""
    @F.arrow_udf("array<struct<source: string, frequency: bigint>>")
    def count(rows: pa.Array) -> pa.Array:
        ends, parts = [0], []
        for at in range(0, len(rows), 256):
            words, counts = [], []
            for own in rows.slice(at, 256).to_pylist():
                n = Counter()
                for t in own:
                    n.update(WORD.findall(t))
                top = sorted((x for x in n.items() if x[1] >= least), key=lambda x: (-x[1], x[0]))
                words += [x[0] for x in top]
                counts += [x[1] for x in top]
                ends.append(ends[-1] + len(top))
            parts.append(pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["source", "frequency"]))
        flat = pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("source", pa.string()), ("frequency", pa.int64())]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return count(texts)


def occurrences_in_text(text: Column, terms: Column) -> Column:
    """Non-overlapping occurrences of every term of an array in a lower-case text, in its order.

    A term without white space stands inside one token, so it is looked for in the distinct tokens of the
    text, by its length; what each holds counts as often as the token stands there."""
    @F.arrow_udf("array<bigint>")
    def count(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        ends, parts = [0], []
        for at in range(0, len(texts), 256):
            found = []
            for t, own in zip(texts.slice(at, 256).to_pylist(), wanted.slice(at, 256).to_pylist(), strict=True):
                found += _occurrences(t, own)
                ends.append(len(found) + sum(map(len, parts)))
            parts.append(pa.array(found, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.int64()))
    return count(text, terms)


def _occurrences(text: str | None, terms: list[str | None]) -> list[int | None]:
    if text is None:
        return [0 if t == "" else None for t in terms]
    # A few terms in a short text are counted one by one, which reads less than the tokens cost.
    few = len(text) * len(terms) <= FEW_CHARACTERS
    single = set() if few else {t for t in terms if t and t.split() == [t]}
    n = dict.fromkeys(single, 0)
    lengths = sorted({len(t) for t in single})
    for token, times in Counter(text.split()).items() if single else ():
        size = len(token)
        inside = {p for k in lengths if k <= size for i in range(size - k + 1) if (p := token[i:i + k]) in single}
        for p in inside:
            n[p] += times * token.count(p)
    return [n[t] if t in single else None if t is None else text.count(t) if t else 0 for t in terms]
