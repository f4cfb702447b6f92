"""The multilingual term library: matching, merging and maintenance.

Tables are snapshots: every change returns the next version of a table, which the caller
writes to a new path. Plain parquet has no MERGE.

Library columns: id, domain_id, source, norm, targets (language -> text), strategy,
ai_category, context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import maps as M
from ..functions import text as T
from ..session import written
from ..skew import global_rank, running_sum_by_chunk, salted_join
from . import matching as X
from .extraction import count_in_own_document

META = ["strategy", "ai_category", "context"]


# --- look-ups --------------------------------------------------------------------------------

def exact_matches(terms: DataFrame, library: DataFrame) -> DataFrame:
    """Library row with the same normalised source; the lowest domain wins."""
    first = library.groupBy("norm").agg(F.min_by(F.struct("id", "domain_id", "strategy"), F.struct("domain_id", "id")).alias("m"))
    return salted_join(terms.withColumn("norm", T.normalize_term(F.col("source"))), first, ["norm"], ["doc_id"]) \
        .select(*terms.columns, F.col("m.id").alias("library_id"), F.col("m.domain_id").alias("domain_id"))


def any_value_index(library: DataFrame, per_domain: bool = False) -> DataFrame:
    """One library row per known spelling. A source spelling beats a target spelling, then the
    lowest (domain, id) wins."""
    row = F.struct(*[c for c in library.columns if c != "norm"]).alias("lib")
    by_source = library.select(F.col("norm").alias("key"), F.lit(0).alias("prio"), row)
    by_target = library.select(F.explode(F.map_values("targets")).alias("v"), row).where("v <> ''").select(
        T.normalize_term(F.col("v")).alias("key"), F.lit(1).alias("prio"), "lib")
    both = by_source.unionByName(by_target)
    keys = [F.col("key")] + ([F.col("lib.domain_id").alias("domain_id")] if per_domain else [])
    return both.groupBy(*keys).agg(F.min_by("lib", F.struct("prio", "lib.domain_id", "lib.id")).alias("lib"))


def match_any_value(terms: DataFrame, library: DataFrame, how: str = "left") -> DataFrame:
    keyed = terms.withColumn("key", T.normalize_term(F.col("source")))
    return salted_join(keyed, any_value_index(library), ["key"], ["doc_id"], how)


def longest_first(library: DataFrame, domains: list[int]) -> DataFrame:
    """Terms of the given domains with their place, longest first."""
    return global_rank(library.where(F.col("domain_id").isin(domains)), [F.desc(F.length("source")), F.col("domain_id"), F.col("id")])


def domain_sizes(domains: DataFrame, library: DataFrame) -> DataFrame:
    sizes = library.groupBy("domain_id").agg(F.count("*").alias("n"))
    return domains.join(sizes, "domain_id", "left").select(
        *domains.columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("term_count"))


def visible_languages(library: DataFrame) -> DataFrame:
    used = library.select(F.explode(F.map_keys("targets")).alias("lang"))
    return used.unionByName(library.sparkSession.createDataFrame([("en",)], "lang string")).distinct()


def usable_constraints(library: DataFrame, languages: list[str]) -> DataFrame:
    """(term, lang) pairs a text request may use: not skipped, and hard terms need a target."""
    pairs = library.where("strategy <> 'skip'").withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages])))
    value = F.coalesce(F.element_at("targets", F.col("lang")), F.lit(""))
    return pairs.where((F.col("strategy") != "hard") | (value != ""))


# --- merging extracted terms with the library -------------------------------------------------

class LibraryForms:
    """A held library for supplement(), as arrays that are made once: which rows a spelling belongs to, which of them
    share a normalised source, and which normalised sources stand inside other strings."""

    def __init__(self, rows: list, forms: list):
        """rows: (id, domain_id, norm, length of source) by domain and id; forms: (id, term, lower-case term, is_source)."""
        self.ids, self.domains, self.chars = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3))
        self.norms = list(dict.fromkeys(r[2] for r in rows))
        number = {n: i for i, n in enumerate(self.norms)}
        self.norm_of = np.array([number[r[2]] for r in rows], np.int64)
        place = {r[0]: i for i, r in enumerate(rows)}
        self.terms = sorted({(t, low) for _, t, low, _ in forms})
        at = {t: i for i, t in enumerate(self.terms)}
        owned = sorted((at[t, low], place[i], own) for i, t, low, own in forms)
        self.forms = X.Lists(np.int32, bool)
        self.forms.add(np.bincount([o[0] for o in owned], minlength=len(self.terms)), *(np.array([o[i] for o in owned], np.int64) for i in (1, 2)))
        self.inner, self.own, self.known = X.Lists(np.int32), np.zeros(0, np.int64), {}
        self.held = X.FlatTerms([(n, n) for n in self.norms])
        self.covers(self.norms)  # so the number of a cover that is a normalised source is that of the source

    def covers(self, strings: list[str]) -> np.ndarray:
        """Numbers of covering strings. What stands inside one is looked up once."""
        new = list(dict.fromkeys(x for x in strings if x not in self.known))
        if new:
            own = np.full(len(new), -1) if self.known else np.arange(len(new))
            row, norm, _, _ = self.held.search(new)
            other = norm != own[row]
            self.inner.add(np.bincount(row[other], minlength=len(new)), norm[other])
            self.own = np.concatenate([self.own, own])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return np.array([self.known[x] for x in strings], np.int64)

    def found(self, matched: pa.Array, doc, term, n, bounded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, library row, frequency) of what stands in documents beside what is matched there."""
        place, row, source = self.forms.of(term)
        key = doc[place] * len(self.ids) + row
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0])) if len(order) else order
        if not len(start):
            return start, start, start
        stands = np.logical_or.reduceat(bounded[place][order], start)
        frequency = np.add.reduceat((n[place] * source)[order], start)[stands]
        doc, row = np.divmod(key[order][start][stands], len(self.ids))
        ends = np.asarray(matched.offsets)
        of, cover = np.repeat(np.arange(len(matched)), np.diff(ends)), self.covers(matched.flatten().to_pylist())
        wide, known = len(self.norms), self.own[cover] >= 0
        key = doc * wide + self.norm_of[row]
        free = ~np.isin(key, of[known] * wide + self.own[cover][known])
        doc, row, frequency, key = doc[free], row[free], frequency[free], key[free]
        order = np.argsort(key, kind="stable")  # rows ascend by domain and id
        first = order[np.concatenate([[True], np.diff(key[order]) > 0])] if len(order) else order
        doc, row, frequency, key = doc[first], row[first], frequency[first], key[first]
        place, inside = self.inner.of(np.concatenate([self.norm_of[row], cover]))
        kept = ~np.isin(key, np.concatenate([doc, of])[place] * wide + inside)
        return doc[kept], row[kept], frequency[kept]


def _with_library(rows: DataFrame, library: DataFrame, held: bool, how: str = "inner") -> DataFrame:
    """Rows joined with library columns by id; a held library is sent to the tasks, however large Spark takes it for."""
    return rows.join(F.broadcast(library), "id", how) if held else salted_join(rows, library, ["id"], ["doc_id"], how)


def _supplement(docs: DataFrame, library: DataFrame, matched: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, id, frequency, domain_id, chars) of supplement(), and whether the library is held."""
    forms = library.select("id", F.col("source").alias("term"), F.lit(True).alias("is_source")).unionByName(
        library.select("id", F.explode(F.map_values("targets")).alias("term"), F.lit(False).alias("is_source"))
    ).where("term <> ''").groupBy("id", "term").agg(F.max("is_source").alias("is_source"))
    _, held = X.usable_terms(forms)
    if held is None or not X.one_row_each(docs):
        lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "source_text"))
        return _supplement_by_joins(X.term_hits(lines, forms), forms, library, matched), False
    rows = library.orderBy("domain_id", "id").select("id", "domain_id", "norm", F.length("source")).collect()
    usable = forms.where(F.length(F.trim("term")) > 0).select("id", "term", F.lower("term"), "is_source").collect()
    index = LibraryForms([tuple(r) for r in rows], [tuple(r) for r in usable])
    shared = docs.sparkSession.sparkContext.broadcast(index)
    covers = matched.groupBy("doc_id").agg(F.collect_set("norm").alias("_covers"))

    def write(_, parts):
        own = shared.value
        for part, (doc, term, n, bounded, _) in parts:
            doc, row, n = own.found(part.column("_covers"), doc, term, n, bounded)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), *(
                pa.array(x, pa.int64()) for x in (own.ids[row], n, own.domains[row], own.chars[row]))], ["doc_id", "id", "frequency", "domain_id", "chars"])
    texts = docs.select("doc_id", "text").join(covers, "doc_id", "left")
    return X.in_documents(texts, index.terms, write, f"doc_id {dict(docs.dtypes)['doc_id']}, id bigint, frequency bigint, domain_id bigint, chars bigint"), True


def _supplement_by_joins(hits: DataFrame, forms: DataFrame, library: DataFrame, matched: DataFrame) -> DataFrame:
    """The same for a library of any size."""
    found = (salted_join(hits, forms, ["term"], ["doc_id"]).groupBy("doc_id", "id").agg(
        F.bool_or("bounded").alias("found"), F.sum(F.when(F.col("is_source"), F.col("n"))).alias("frequency")).where("found"))
    named = salted_join(found, library.select("id", "domain_id", "norm"), ["id"], ["doc_id"])
    one = (named.join(matched, ["doc_id", "norm"], "left_anti").groupBy("doc_id", "norm").agg(
        F.min_by(F.struct("id", "frequency"), F.struct("domain_id", "id")).alias("f"))
        .select("doc_id", "norm", "f.id", F.coalesce("f.frequency", F.lit(0)).cast("bigint").alias("frequency")))
    one = written(one, "found-terms")
    kept = X.drop_contained(one, one.select("doc_id", "norm").unionByName(matched))
    return salted_join(kept.drop("norm"), library.select("id", "domain_id", F.length("source").cast("bigint").alias("chars")), ["id"], ["doc_id"])


def _supplement_columns(library: DataFrame, languages: Column) -> DataFrame:
    missing = M.missing_languages(F.col("targets"), languages)
    return library.select("id", "source", "norm", "targets", *META, F.when(F.size(missing) > 0, F.concat(
        F.lit("MISSING_TRANSLATIONS:"), F.array_join(missing, ","))).otherwise(F.lit("")).alias("uncertainty_note"))


def supplement(docs: DataFrame, library: DataFrame, matched: DataFrame, languages: Column) -> DataFrame:
    """Library terms that occur in a text though nobody extracted them; `matched` is (doc_id, norm) of the extracted
    terms the library already covers. While the library is held, a text meets what is matched in it once, and all
    the rest is decided in its row; else it goes by joins, with equal results."""
    found, held = _supplement(docs, library, matched)
    return _with_library(found.drop("chars"), _supplement_columns(library, languages), held)


def merge_extracted(terms: DataFrame, docs: DataFrame, library: DataFrame, languages: Column) -> DataFrame:
    """Extracted terms joined with the library: matched first, then supplemented, then new.

    The library wins per language, the extraction fills gaps; ids are renumbered per document. What is
    supplemented is numbered by its library ids; its texts are added after that, so they are not moved.
    """
    m = written(match_any_value(terms, library).withColumn("lib", F.when(F.col("lib").isNotNull(), F.struct(
        "lib.id", "lib.targets", "lib.strategy"))), "matched-terms")
    hit = m.where("lib is not null")
    merged = M.prefer_right(F.col("targets"), F.col("lib.targets"))
    note = M.uncertainty_note(F.col("targets"), F.col("lib.targets"), merged, languages)
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    matched = count_in_own_document(hit.select(
        "doc_id", "source", "frequency", merged.alias("targets"), F.col("lib.strategy").alias("strategy"),
        F.lit(True).alias("confirmed"), note.alias("uncertainty_note"), F.col("lib.id").alias("library_id"),
        F.lit(0).alias("part"), F.col("pos").alias("rank1"), zero.alias("rank2"), zero.alias("rank3")), docs)
    new = m.where("lib is null").select(
        "doc_id", "source", "frequency", "targets", "strategy", "confirmed", F.lit("").alias("uncertainty_note"),
        none.cast("bigint").alias("library_id"), F.lit(2).alias("part"), F.col("pos").alias("rank1"),
        zero.alias("rank2"), zero.alias("rank3"))
    found, held = _supplement(docs, library, hit.select("doc_id", F.col("key").alias("norm")).distinct())
    text = none.cast("string")
    extra = found.select(
        "doc_id", text.alias("source"), "frequency", none.cast(M.EMPTY).alias("targets"), text.alias("strategy"),
        none.cast("boolean").alias("confirmed"), text.alias("uncertainty_note"), F.col("id").alias("library_id"), F.lit(1).alias("part"),
        (-F.col("chars")).alias("rank1"), F.col("domain_id").alias("rank2"), F.col("id").alias("rank3"))
    out = matched.unionByName(extra).unionByName(new)
    w = Window.partitionBy("doc_id").orderBy("part", "rank1", "rank2", "rank3")
    numbered = out.withColumn("term_no", F.row_number().over(w)).withColumn("id", F.when(F.col("part") == 1, F.col("library_id")))
    own = _supplement_columns(library, languages).select("id", F.struct(
        "source", "targets", "strategy", (F.col("uncertainty_note") == "").alias("confirmed"), "uncertainty_note").alias("own"))
    pick = lambda c: F.when(F.col("part") == 1, F.col(f"own.{c}")).otherwise(F.col(c)).alias(c)
    rows = _with_library(numbered, own, held, "left").select(
        "doc_id", pick("source"), "frequency", *[pick(c) for c in ("targets", "strategy", "confirmed", "uncertainty_note")], "library_id", "term_no")
    return (rows.withColumn("term_id", F.format_string("term_%03d", F.col("term_no")))
            .withColumn("uncertain", F.col("uncertainty_note") != ""))


# --- maintenance ------------------------------------------------------------------------------

def premerge(batch: DataFrame) -> DataFrame:
    """One row per (domain, norm) of an import batch, as if its rows were applied in row order:
    the last metadata and the last filled value per language count."""
    b = batch.withColumn("source", T.strip(F.col("source"))).where("source <> ''").withColumn("norm", T.normalize_term(F.col("source")))
    last = b.groupBy("domain_id", "norm").agg(
        F.max_by(F.struct("source", *META), "row_no").alias("last"), F.count("*").alias("n_rows"),
        F.min("row_no").alias("first_row"))
    values = b.select("domain_id", "norm", "row_no", F.explode("targets").alias("lang", "value")).where("value <> ''")
    per_lang = values.groupBy("domain_id", "norm", "lang").agg(F.max_by("value", "row_no").alias("value"))
    maps = per_lang.groupBy("domain_id", "norm").agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("targets"))
    return last.join(maps, ["domain_id", "norm"], "left").select(
        "domain_id", "norm", "last.*", M.or_empty(F.col("targets")).alias("targets"), "n_rows", "first_row")


def upsert(library: DataFrame, batch: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """Next library version with `existed` and `n_rows` beside each row for the summary."""
    new = premerge(batch).select("domain_id", "norm", F.struct("source", "targets", *META).alias("new"), "n_rows", "first_row")
    old = library.select("domain_id", "norm", "id", F.struct("source", "targets", *META).alias("old"))
    j = old.join(new, ["domain_id", "norm"], "full")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    out = j.select("domain_id", "norm", "id", pick("source"), *[pick(c) for c in META], "first_row",
                   M.upsert(F.col("old.targets"), F.col("new.targets")).alias("targets"),
                   F.col("old").isNotNull().alias("existed"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    kept, added = out.where("existed").drop("first_row"), out.where("not existed")
    numbered = running_sum_by_chunk(added, [], ["first_row"], F.floor(F.col("first_row") / chunk_rows), F.lit(1), "_no")
    top = library.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).select("top").scalar()
    return kept.unionByName(numbered.withColumn("id", F.col("_no") + top).drop("_no", "first_row"))


def import_summary(upserted: DataFrame) -> DataFrame:
    """The first row of an unknown term is an insert, every other row an update."""
    return upserted.where("n_rows > 0").agg(
        F.coalesce(F.sum(F.when(~F.col("existed"), 1)), F.lit(0)).cast("bigint").alias("inserted"),
        (F.sum("n_rows") - F.coalesce(F.sum(F.when(~F.col("existed"), 1)), F.lit(0))).cast("bigint").alias("updated"))


def update_terms(library: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (id, targets, and optionally source, strategy, ai_category, context).

    Null means unchanged; an empty target clears a language the term has."""
    fields = [c for c in ("source", *META) if c in edits.columns]
    e = edits.select("id", F.struct("targets", *fields).alias("_e"))
    out = library.join(e, "id", "left")
    out = out.withColumn("targets", M.update(F.col("targets"), F.col("_e.targets")))
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_e.{f}"), F.col(f)))
    return out.withColumn("norm", T.normalize_term(F.col("source"))).drop("_e").select(library.columns)


def delete_terms(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id"), "id", "left_anti")


def delete_domain(domains: DataFrame, library: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the given domains and without their terms."""
    gone = ids.select("domain_id")
    return domains.join(gone, "domain_id", "left_anti"), library.join(gone, "domain_id", "left_anti")


def touch(library: DataFrame, used: DataFrame, at: Column) -> DataFrame:
    """Count a use once per call however often an id is listed."""
    ids = used.select("id").distinct().withColumn("_hit", F.lit(True))
    return (library.join(ids, "id", "left")
            .withColumn("use_count", F.col("use_count") + F.when(F.col("_hit"), 1).otherwise(0))
            .withColumn("last_used_at", F.when(F.col("_hit"), at).otherwise(F.col("last_used_at"))).drop("_hit"))


def ensure_domains(domains: DataFrame, names: DataFrame) -> DataFrame:
    """Get-or-create by name; new ids follow the largest existing one, in the order of the names."""
    wanted = names.select(T.strip(F.col("name")).alias("name")).distinct().join(domains.select("name"), "name", "left_anti")
    top = domains.agg(F.coalesce(F.max("domain_id"), F.lit(0)).alias("top")).select("top").scalar()
    numbered = global_rank(wanted, [F.col("name")], "_new").withColumn("domain_id", F.col("_new") + top)
    return domains.select("domain_id", "name").unionByName(numbered.select("domain_id", "name"))


def rename_domain(domains: DataFrame, domain_id: int, name: str) -> DataFrame:
    return domains.withColumn("name", F.when(F.col("domain_id") == domain_id, F.lit(name.strip())).otherwise(F.col("name")))


def default_domains(domains: DataFrame) -> DataFrame:
    """Add the standard domains that are missing; running it twice changes nothing."""
    spark = domains.sparkSession
    return ensure_domains(domains, spark.createDataFrame([(x,) for x in K.DOMAINS], "name string"))


def target_domains(docs: DataFrame, domains: DataFrame) -> DataFrame:
    """(doc_id, domain_id) to save into: the user's choice, else the detected domains, else general.

    `docs` has doc_id, chosen array<bigint>, detected array<string>."""
    chosen = docs.where(F.size("chosen") > 0).select("doc_id", F.explode("chosen").alias("domain_id"))
    names = F.when(F.size("detected") > 0, F.col("detected")).otherwise(F.array(F.lit("general")))
    detected = (docs.where(F.size("chosen") <= 0).select("doc_id", F.explode(names).alias("raw"))
                .select("doc_id", T.normalize_domain(F.col("raw")).alias("name"))
                .join(domains.select("domain_id", "name"), "name").select("doc_id", "domain_id"))
    return chosen.unionByName(detected).distinct()


def save_back(terms: DataFrame, routes: DataFrame, library: DataFrame, languages: list[str],
              source_language: str = "en") -> DataFrame:
    """Route confirmed terms: `new` rows go to every target domain (merging into a row that knows
    the spelling), `update` rows overwrite their library row, `accumulate` rows add new languages.

    `terms`: doc_id, pos, source, targets, strategy, ai_category, context, library_id, save, sync.
    Returns one row per write: route, domain_id or id, and the targets to apply.
    """
    enriched = M.prefer_right(F.create_map(F.lit(source_language), F.col("source")), F.col("targets"))
    t = terms.where("strategy <> 'skip'").withColumn("targets", enriched).withColumn(
        "route", F.when(F.col("library_id").isNull() & F.col("save"), "new")
        .when(F.col("library_id").isNotNull() & F.col("sync"), "update")
        .when(F.col("library_id").isNotNull(), "accumulate")).where("route is not null")
    wanted = F.map_filter("targets", lambda l, v: l.isin(languages) & (v != ""))
    acc = t.where("route = 'accumulate'").withColumn("targets", wanted).where(F.size("targets") > 0).withColumn(
        "strategy", F.lit(None).cast("string")).withColumn("context", F.lit(None).cast("string"))
    own = t.where("route = 'update'").unionByName(acc).withColumn("domain_id", F.lit(None).cast("bigint"))
    new = t.where("route = 'new'").join(routes, "doc_id").withColumn("key", T.normalize_term(F.col("source")))
    index = any_value_index(library, per_domain=True).select("key", "domain_id", F.col("lib.id").alias("_known"))
    merged = salted_join(new, index, ["key", "domain_id"], ["doc_id"], "left").withColumn("library_id", F.col("_known")).drop("_known", "key")
    return own.unionByName(merged)


def save_summary(writes: DataFrame) -> DataFrame:
    """Saved and updated terms; a term saved into several domains counts once."""
    term = F.struct("doc_id", "pos")
    return writes.agg(F.count_distinct(F.when(F.col("route") == "new", term)).alias("new_terms"),
                      F.count_distinct(F.when(F.col("route") == "update", term)).alias("updated_terms"))
