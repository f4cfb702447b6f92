"""Resource files (PO, JSON, XML, XLIFF, term sheets) as blocks. A file is one row (doc_id, text)."""

from __future__ import annotations

import json
from collections import Counter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

# --- gettext ----------------------------------------------------------------------------------


def _po_field(entry: Column, name: str) -> Column:
    """Joined string of a possibly multi-line field; null when the field is absent."""
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    field = rf'(?m)^{name}[ \t]+((?:{quoted}\s*+)++)'
    parts = F.transform(F.regexp_extract_all(F.regexp_extract(entry, field, 1), F.lit(quoted), F.lit(0)),
                        lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    joined = F.array_join(parts, "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        joined, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"(?<!\\)((?:\\\\)*)\\t", "$1\t"), r'\\"', '"'), r"\\\\", r"\\")
    return F.when(F.regexp_like(entry, F.lit(field)), plain)


def po_blocks(files: DataFrame) -> DataFrame:
    # The strings of an entry end it, with or without a blank line before the next one.
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t]*+'
    ends = rf"(?m)^(msgstr(?:\[\d+\])?[ \t]+{quoted}(?:\n[ \t]*{quoted})*+)\n(?=[ \t]*(?:#|msgctxt\s|msgid\s))"
    apart = F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), ends, "$1\n\n")
    entries = F.filter(F.split(apart, r"\n[ \t]*\n"), lambda e: F.regexp_like(e, F.lit(r"(?m)^msgid\s")))
    e = files.select("doc_id", F.posexplode_outer(entries).alias("block_no", "e"))
    fields = e.select("doc_id", "block_no", T.strip(_po_field(F.col("e"), "msgid")).alias("msgid"), _po_field(F.col("e"), "msgctxt").alias("msgctxt"),
                      _po_field(F.col("e"), "msgid_plural").alias("msgid_plural"),
                      F.array_join(F.regexp_extract_all("e", F.lit(r"(?m)^#,[ \t]*(.*)$"), F.lit(1)), ", ").alias("flags"))
    key = F.concat(F.coalesce("msgctxt", F.lit("")), F.lit("::"), "msgid")
    return fields.where(T.is_translatable(F.col("msgid"))).select(
        "doc_id", "block_no", F.concat(F.lit("po_"), F.substring(F.md5(key), 1, 12)).alias("block_id"), F.col("msgid").alias("source_text"),
        "msgctxt", "msgid_plural", "flags")


# --- JSON -------------------------------------------------------------------------------------

def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("an object names a key twice")
    return out


def _no_number(name):
    raise ValueError(name)


def _leaves(text: str | None, skip: frozenset) -> list[tuple[str, str]]:
    """Text leaves of one file in file order, with their paths. A file that is not valid JSON, names a
    key twice or nests deeper than the parser goes (about a thousand levels) has none."""
    try:
        root = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_number) if text else None
    except (ValueError, RecursionError):
        return []
    out, stack = [], [("", root)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, str):
            out.append((path, node))
            continue
        items = [(k, v) for k, v in node.items() if k not in skip] if isinstance(node, dict) else (
            enumerate(node) if isinstance(node, list) else ())
        stack += reversed([(f"{path}.{k}" if path else str(k), v) for k, v in items])
    return out


def json_leaves(files: DataFrame) -> DataFrame:
    """(doc_id, key_path, value) of every text leaf; values under skipped keys are not visited.

    The tree of a file is walked inside its row, so neither depth nor the number of leaves of all files
    together is limited.
    """
    skip = frozenset(K.JSON_SKIP_KEYS)
    columns = ["doc_id", "key_path", "value"]

    def walk(frames):
        for f in frames:
            rows = [(d, *leaf) for d, t in zip(f["doc_id"], f["text"], strict=True) for leaf in _leaves(t, skip)]
            yield pd.DataFrame(rows, columns=columns)

    kind = files.schema["doc_id"].dataType.simpleString()
    leaves = files.select("doc_id", "text").mapInPandas(walk, f"doc_id {kind}, key_path string, value string")
    return leaves.where(T.strip(F.col("value")) != "")


def json_blocks(files: DataFrame) -> DataFrame:
    v = F.col("value")
    return json_leaves(files).where(T.is_translatable(v) & ~T.looks_like_code(F.col("key_path"), v)).select(
        "doc_id", F.translate("key_path", ".[]", "_").alias("block_id"), "key_path", v.alias("source_text"))


def value_at(doc: Column, path: str, kind: str = "string") -> Column:
    """A value of a parsed document by dot path; numbers index arrays."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(doc, "$" + steps, kind)


# --- XML --------------------------------------------------------------------------------------

def _tree(text: str | None):
    """Root of a file that is well-formed XML, else None."""
    try:
        return ElementTree.fromstring(text) if text else None
    except (ElementTree.ParseError, ValueError):
        return None


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _resource_texts(text: str | None) -> list[tuple]:
    """(key_path, attr, text) of leaf elements and prose attributes in file order. What stands in a
    protected or skipped element is not visited."""
    root = _tree(text)
    out, stack = [], [] if root is None else [(root, "/" + _name(root))]
    while stack:
        e, path = stack.pop()
        if _name(e) in K.XML_SKIP_TAGS or e.get("translatable") == "false" or e.get("translate") == "no":
            continue
        if not len(e):
            out.append((e.get("name") or path, None, e.text or ""))
        out += [(f"{path}@{a}", a, e.get(a)) for a in K.XML_TEXT_ATTRS if e.get(a)]
        seen: Counter = Counter()
        below = []
        for child in e:
            seen[child.tag] += 1
            below.append((child, f"{path}/{_name(child)}[{seen[child.tag]}]"))
        stack += reversed(below)
    return out


def _inline(source) -> str:
    """Text of a unit with its inline elements as placeholders."""
    mark = lambda e: f"<{_name(e)}" + (f" id='{e.get('id')}'" if e.get("id") else "") + " />"
    return (source.text or "") + "".join(mark(e) + (e.tail or "") for e in source)


def _units(text: str | None) -> list[tuple]:
    """(block_id, version, text) of the units of XLIFF 1.2 and 2.0, told apart by element."""
    root = _tree(text)
    out = []
    for unit in () if root is None else root.iter():
        kind = _name(unit)
        if kind not in ("trans-unit", "unit") or unit.get("translate") == "no":
            continue
        parts = [unit] if kind == "trans-unit" else [s for s in unit if _name(s) == "segment"]
        for k, part in enumerate(parts):
            number = f"_{k}" if k else ""
            prefix, version = ("tu_", "1.2") if kind == "trans-unit" else ("unit_", "2.0")
            out += [(f"{prefix}{unit.get('id', '')}{number}", version, _inline(s)) for s in part if _name(s) == "source"]
    return out


def _parsed(files: DataFrame, parse, columns: list[str]) -> DataFrame:
    """Rows of parse(text) of every file, numbered inside the file."""
    def run(frames):
        for f in frames:
            rows = [(d, i, *r) for d, t in zip(f["doc_id"], f["text"], strict=True) for i, r in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", *columns])

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, seq int, " + ", ".join(f"{c} string" for c in columns))


def string_resources(files: DataFrame) -> DataFrame:
    """Texts of leaf elements and prose attributes of all elements; a leaf is named by its `name` or its
    path. A file that is not well-formed has none."""
    rows = _parsed(files, _resource_texts, ["key_path", "attr", "source_text"])
    return rows.withColumn("source_text", T.strip(F.col("source_text"))).where(T.is_translatable(F.col("source_text")))


def xliff_units(files: DataFrame) -> DataFrame:
    """Units of XLIFF 1.2 and 2.0 files, inline elements as placeholders; segments of one unit are numbered."""
    rows = _parsed(files, _units, ["block_id", "version", "source_text"])
    return rows.where(T.is_translatable(F.col("source_text"))).drop("seq")


# --- term sheets and stores -------------------------------------------------------------------

SHEET_FIELDS = ["strategy", "context", "category", "ai_category", "source"]


def import_terms(sheet: DataFrame, row_no: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(terms, skipped) of a term sheet whose other headers are language codes.

    A row becomes a list of (language, text) with `en` in front and empty cells left out; the first
    one names the term. A `source` column fills `en` where that is empty.
    """
    columns = {c.strip().lower(): c for c in sheet.columns if c != row_no}
    text = lambda *names: F.coalesce(*[F.nullif(T.strip(F.col(f"`{columns[n]}`")), F.lit("")) for n in names if n in columns],
                                     F.lit(None).cast("string"))
    english = [n for n in ("en", "source") if n in columns]
    others = [n for n in columns if n not in (*SHEET_FIELDS, "en")]
    if not english and not others:
        raise ValueError("no language columns: use language codes as headers")
    cell = lambda code, value: F.struct(F.lit(code).alias("lang"), value.alias("text"))
    cells = ([cell(columns.get("en", "en").strip(), text(*english))] if english else []) + [
        cell(columns[n].strip(), text(n)) for n in others]
    rows = sheet.withColumn("_filled", F.filter(F.array(*cells), lambda c: c["text"].isNotNull()))
    named = F.size("_filled") > 0
    fixed = {"strategy": (("strategy",), "hard"), "ai_category": (("ai_category", "category"), ""), "context": (("context",), "")}
    terms = rows.where(named).select(
        row_no, F.map_from_entries("_filled").alias("targets"), F.get("_filled", F.lit(0))["text"].alias("source"),
        *[F.coalesce(text(*names), F.lit(otherwise)).alias(name) for name, (names, otherwise) in fixed.items()])
    return terms, rows.where(~named).select(row_no)


def read_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of a CSV or TSV file with their order. All columns are text."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')
    return df.withColumn("row_no", F.monotonically_increasing_id())


def eval_runs(spark: SparkSession, path: str, one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs, corrupt) of saved evaluation files."""
    schema = ("run_id string, timestamp string, prompt_version string, average_overall double, notes string, "
              "results array<struct<file_name:string,target_language:string,overall:double>>, _bad string")
    df = spark.read.schema(schema).option("multiLine", str(one_per_file).lower()).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.col("_metadata.file_name"))
    return df.where("_bad is null").drop("_bad"), df.where("_bad is not null").select("file")


def reply_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(request_key, reply) of cached reply files named by their key."""
    df = spark.read.schema("reply string").option("multiLine", "true").json(folder)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-f]{64})\.json$", 1).alias("request_key"), "reply").where(
        "request_key <> '' and reply is not null")
