"""Work on the confirmed terms of documents: constraints, edits, tables and annotations.

A glossary belongs to one document and comes from one reply plus the matching library terms, so
its terms may travel as one array.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import maps as M
from ..functions import text as T
from ..session import written
from ..skew import salted_join


OPENING, CLOSING = "(（", ")）"


def _folded(text: str) -> str:
    """Case taken away character by character, so places stay the same."""
    return "".join(low if len(low := (c.upper() if len(c.upper()) == 1 else c).lower()) == 1 else c for c in text)


class AnnotationIndex:
    """Terms of a document by their source; an opening bracket asks once for each length of a source."""

    def __init__(self, terms):
        self.by_source: dict[str, list[tuple[str, int, str]]] = {}
        for t in terms:
            source = _folded(t["source"].strip())
            self.by_source.setdefault(source, []).append((_folded(t["target"].strip()), t["pos"], t["target"]))
        self.lengths = sorted({len(x) for x in self.by_source})

    def find(self, text: str) -> tuple[list[tuple[int, int, str, str, str]], str]:
        """Notes `target (source)` from left to right, none within another: (pos, start, text before it,
        its text, plain target), and the text after the last. Of several at one bracket the one that
        starts first counts, then the lowest pos."""
        folded, out, done = _folded(text), [], 0
        for m in re.finditer(f"[{OPENING}]", text):
            if m.start() < done:
                continue
            left, inner = m.start(), m.end()
            while left > done and text[left - 1].isspace():
                left -= 1
            while inner < len(text) and text[inner].isspace():
                inner += 1
            best = None
            for n in self.lengths:
                stop = inner + n
                known = self.by_source.get(folded[inner:stop]) if stop < len(text) else None
                if not known:
                    continue
                while stop < len(text) and text[stop].isspace():
                    stop += 1
                if stop == len(text) or text[stop] not in CLOSING:
                    continue
                for target, pos, plain in known:
                    start = left - len(target)
                    if start >= done and folded.startswith(target, start) and (best is None or (start, pos) < best[:2]):
                        best = (start, pos, stop + 1, plain)
            if best:
                start, pos, stop, plain = best
                out.append((pos, start, text[done:start], text[start:stop], plain))
                done = stop
        return out, text[done:]


NOTES = "array<struct<pos: int, start: int, before: string, note: string, plain: string>>"


def keep_first_annotation(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Keep `target (source)` at its first place in a document and write plain `target` later.

    blocks: doc_id, block_no, text. terms: doc_id, pos, source, target, if wanted do_not_translate.
    Case is ignored in all scripts; terms of a document that are equal but for case are one, and terms
    that are not translated carry no note. Where a term first stands is decided on the text as it came in.

    A block with a bracket is walked once, from left to right, whatever the number of terms; its text comes
    back cut at the notes. First places are a grouped minimum, and joining the pieces again needs no search.
    """
    t = terms.where("trim(target) <> '' and trim(source) <> ''")
    if "do_not_translate" in terms.columns:
        t = t.where(~F.coalesce("do_not_translate", F.lit(False)))
    t = (t.groupBy("doc_id", F.lower("source").alias("_s"), F.lower("target").alias("_t"))
         .agg(F.min(F.struct("pos", "source", "target")).alias("_x")).select("doc_id", "_x.*"))
    packed = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "source", "target"))).alias("terms"))
    rows = blocks.select("doc_id", "block_no", "text")
    bracket = F.coalesce(F.regexp_like("text", F.lit(f"[{OPENING}]")), F.lit(False))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def walk(frames):
        held, of = None, None
        for f in frames:
            found = []
            for doc, text, own in zip(f["doc_id"], f["text"], f["terms"], strict=True):
                if held is None or of != doc:
                    held, of = AnnotationIndex(own), doc
                found.append(held.find(text))
            out = f[["doc_id", "block_no"]].copy()
            out["notes"], out["rest"] = [x[0] for x in found], [x[1] for x in found]
            yield out
    cut = salted_join(rows.where(bracket), packed, ["doc_id"], ["block_no"]).select("doc_id", "block_no", "text", "terms")
    cut = written(cut.mapInPandas(walk, f"doc_id {fields['doc_id']}, block_no {fields['block_no']}, notes {NOTES}, rest string")
                  .where("size(notes) > 0"), "annotated-blocks")
    first = (cut.select("doc_id", "block_no", F.explode("notes").alias("n")).groupBy("doc_id", "n.pos")
             .agg(F.min(F.struct("block_no", "n.start")).alias("f"))
             .groupBy("doc_id", F.col("f.block_no").alias("block_no")).agg(F.collect_list(F.struct("pos", "f.start")).alias("first")))
    place = lambda n: F.struct(n["pos"].alias("pos"), n["start"].alias("start"))
    text = F.transform("notes", lambda n: F.concat(n["before"], F.when(F.array_contains(F.col("first"), place(n)), n["note"]).otherwise(n["plain"])))
    clean = cut.join(first, ["doc_id", "block_no"], "left").withColumn(
        "first", F.coalesce("first", F.array().cast("array<struct<pos: int, start: int>>")))
    clean = clean.select("doc_id", "block_no", F.concat(F.array_join(text, ""), "rest").alias("_clean"))
    return (rows.join(clean, ["doc_id", "block_no"], "left")
            .select("doc_id", "block_no", F.coalesce("_clean", "text").alias("text")))


def constraint_lines(terms: DataFrame, lang: Column, first_use: Column | None = None) -> DataFrame:
    """Add `line` and `soft` to terms; rows that say nothing drop out.

    Confirmed terms bind, unconfirmed hard ones with another target are preferences."""
    keep = F.coalesce(F.col("do_not_translate"), F.lit(False)) if "do_not_translate" in terms.columns else F.lit(False)
    target = M.resolve_target(F.col("targets"), lang, F.col("source"), keep)
    how = F.when((F.col("strategy") == "hard") & keep, "keep_original").otherwise(F.col("strategy"))
    note = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(" ("), "context", F.lit(")"))).otherwise("")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.lit(False) if first_use is None else first_use
    must = F.when(first, F.concat(F.lit("must use "), q(target), F.lit(" and on the first occurrence in this segment use "),
                                  q(F.concat(target, F.lit(" ("), F.col("source"), F.lit(")"))))).otherwise(F.concat(F.lit("must use "), q(target)))
    rule = (F.when(F.col("confirmed") & (how == "keep_original"), F.lit("keep unchanged, do not translate"))
            .when(F.col("confirmed") & (how == "hard") & (target != ""), must)
            .when(~F.col("confirmed") & (F.col("strategy") == "hard") & (target != "") & (target != F.col("source")),
                  F.concat(F.lit("prefer "), q(target))))
    return (terms.withColumn("soft", ~F.col("confirmed"))
            .withColumn("line", F.concat(F.lit("- "), q(F.col("source")), F.lit(" -> "), rule, note)).where("line is not null"))


def constraint_text(lines: DataFrame, keys: list[str], bilingual: bool = False) -> DataFrame:
    """One prompt section per key from constraint lines in glossary order."""
    body = lambda soft: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("soft") == soft, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    g = lines.groupBy(*keys).agg(body(False).alias("hard"), body(True).alias("soft"))
    head = K.HARD_HEADER + (K.FIRST_USE_HEADER if bilingual else K.DIRECT_HEADER)
    part = lambda c, h: F.when(F.col(c) != "", F.concat(F.lit(h), F.col(c)))
    return g.select(*keys, F.concat_ws("\n\n", part("hard", head), part("soft", K.SOFT_HEADER)).alias("constraints"))


def summary(terms: DataFrame, keys: list[str]) -> DataFrame:
    has = F.col("library_id").isNotNull()
    return terms.groupBy(*keys).agg(
        F.count_if(has).alias("library_terms"), F.count_if(~has).alias("new_terms"),
        F.count_if(F.col("uncertainty_note") != "").alias("uncertain"),
        F.count_if(F.col("strategy") != "skip").alias("constraints"),
        F.greatest(F.lit(1), F.max("frequency")).cast("bigint").alias("max_frequency"))


def languages_in_order(terms: DataFrame) -> DataFrame:
    """Languages of a document's glossary, in order of first appearance."""
    e = terms.select("doc_id", "pos", F.posexplode(F.map_keys("targets")).alias("k", "lang")).where("lang <> ''")
    first = e.groupBy("doc_id", "lang").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "lang"))), lambda x: x["lang"]), ",").alias("languages"))


def confirm(terms: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Confirm all but skipped terms, or exactly the chosen (doc_id, pos) beside those confirmed."""
    if chosen is None:
        return terms.withColumn("confirmed", F.col("confirmed") | (F.col("strategy") != "skip"))
    ids = chosen.select("doc_id", "pos").distinct().withColumn("_c", F.lit(True))
    return (terms.join(ids, ["doc_id", "pos"], "left")
            .withColumn("confirmed", F.col("confirmed") | F.coalesce("_c", F.lit(False))).drop("_c"))


def apply_edits(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc_id, pos, action, strategy, targets, save): `set` patches, `remove` deletes.
    Set targets replace a language even with an empty text.

    The edits of a document come from one save and travel to its terms as one array, so terms that are
    dealt out by document stay where they are."""
    e = edits.where("pos is not null").groupBy("doc_id").agg(F.collect_list(
        F.struct("pos", "action", "strategy", "targets", "save")).alias("_edits"))
    j = terms.join(e, "doc_id", "left").withColumn("_e", F.explode_outer(F.filter("_edits", lambda x: x["pos"] == F.col("pos"))))
    return (j.where("coalesce(_e.action, '') <> 'remove'").withColumn("strategy", F.coalesce("_e.strategy", "strategy"))
            .withColumn("targets", M.prefer_right(F.col("targets"), F.col("_e.targets")))
            .withColumn("save", F.coalesce("_e.save", "save")).drop("_edits", "_e"))


def append_terms(terms: DataFrame, added: DataFrame) -> DataFrame:
    """Add terms (doc_id, seq, ...) with ids that follow the largest number in use."""
    top = terms.groupBy("doc_id").agg(F.max(F.regexp_extract("term_id", r"^term_(\d+)", 1).try_cast("bigint")).alias("_top"))
    new = added.join(top, "doc_id", "left").withColumn(
        "term_id", F.format_string("term_%03d", F.coalesce("_top", F.lit(0)) + F.col("seq"))).drop("_top", "seq")
    return terms.unionByName(new, allowMissingColumns=True)


def modified(edited: DataFrame, original: DataFrame) -> DataFrame:
    """Library-backed terms whose targets differ from the original ones."""
    flat = lambda c: F.array_sort(F.map_entries(c))
    o = original.select("doc_id", "pos", F.col("targets").alias("_o"))
    return (edited.where("library_id is not null").join(o, ["doc_id", "pos"])
            .where(flat(F.col("targets")) != flat(F.col("_o"))).drop("_o"))


def review_filter(terms: DataFrame, uncertain: bool = False, category: str = "all", origin: str = "all") -> DataFrame:
    out = terms
    if uncertain:
        out = out.where("uncertainty_note <> ''")
    if category != "all":
        out = out.where(F.col("ai_category") == category)
    if origin == "library":
        out = out.where("library_id is not null")
    if origin == "new":
        out = out.where("library_id is null")
    return out


def table_rows(terms: DataFrame, languages: list[str]) -> DataFrame:
    """A column per language with its resolved target."""
    keep = F.coalesce(F.col("do_not_translate"), F.lit(False)) if "do_not_translate" in terms.columns else F.lit(False)
    return terms.select("doc_id", "pos", "source", *[
        M.resolve_target(F.col("targets"), F.lit(l), F.col("source"), keep).alias(l) for l in languages],
        "category", "context", "frequency", keep.alias("do_not_translate"))


def as_text(rows: DataFrame, columns: list[str], markdown: bool) -> DataFrame:
    """The glossary of each document as one Markdown or tab-separated text."""
    cell = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")) if dict(rows.dtypes)[c] == "boolean" else F.col(c).cast("string"), F.lit(""))
    if markdown:
        esc = lambda c: F.replace(F.replace(cell(c), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[esc(c) for c in columns]), F.lit(" |"))
        head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |"
    else:
        line, head = F.concat_ws("\t", *[cell(c) for c in columns]), "\t".join(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head + "\n"), body).alias("content"))
