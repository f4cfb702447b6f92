"""Packing the blocks of a document into segments for a model, and context around them.

A document is one row and carries its blocks as an array, bounded by the intake limit on file
size. Packing is a greedy walk that needs the previous decision, so the walk itself runs as a
small function over number arrays prepared by Spark; texts never leave the JVM and nothing is
shuffled. It returns where segments start.

Block struct fields used: text, and by rule also type, group_id, slide, start_s, end_s, key_path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from ..functions import constants as K
from ..functions import text as T

INTS = ArrayType(IntegerType())
BOOLS = ArrayType(BooleanType())


def _walk(n: int, breaks) -> list[int]:
    """Greedy walk: `breaks(start, i)` returns the next start when a segment that began at
    `start` must end before block `i`, else None."""
    starts, s = [0] if n else [], 0
    for i in range(1, n):
        nxt = breaks(s, i)
        if nxt is not None:
            starts.append(nxt)
            s = nxt
    return starts


def _prefix(tokens) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(tokens, dtype=np.int64))])


def _rows(fn, *cols) -> pd.Series:
    return pd.Series([fn(*r) for r in zip(*cols)])


@F.pandas_udf(INTS)
def _general(tokens: pd.Series, hard: pd.Series, soft: pd.Series, glued: pd.Series, limit: pd.Series, size: pd.Series) -> pd.Series:
    def one(t, h, e, g, top, most):
        p = _prefix(t)
        h, e, g = (np.asarray(x, dtype=bool) for x in (h, e, g))
        at = np.arange(len(t))
        fine = ~g & (h | np.concatenate([[False], e[:-1]])) if len(t) else g
        last = np.maximum.accumulate(np.where(fine, at, 0)) if len(t) else at

        def breaks(s, i):
            full = h[i] or (i - s >= most and e[i - 1]) or p[i + 1] - p[s] > top
            if g[i] or not full:
                return None
            back = int(last[i - 1])
            return back if back > s else i
        return _walk(len(t), breaks)
    return _rows(one, tokens, hard, soft, glued, limit, size)


@F.pandas_udf(INTS)
def _budget(tokens: pd.Series, hard: pd.Series, full_ok: pd.Series, limit: pd.Series, size: pd.Series) -> pd.Series:
    def one(t, h, e, top, most):
        p = _prefix(t)
        return _walk(len(t), lambda s, i: i if (
            h[i] or (i - s >= most and e[i - 1]) or p[i + 1] - p[s] > top) else None)
    return _rows(one, tokens, hard, full_ok, limit, size)


@F.pandas_udf(INTS)
def _bundles(tokens: pd.Series, glued: pd.Series, limit: pd.Series) -> pd.Series:
    return _rows(_pack_bundles, tokens, glued, limit)


def _pack_bundles(t, glued, top) -> list[int]:
    """Starts of segments of whole bundles; a bundle begins where a block is not glued."""
    p = _prefix(t)
    heads = [i for i in range(len(t)) if i == 0 or not glued[i]] + [len(t)]
    got = _walk(len(heads) - 1, lambda s, b: b if p[heads[b + 1]] - p[heads[s]] > top else None)
    return [heads[b] for b in got]


@F.pandas_udf(INTS)
def _slides(tokens: pd.Series, slide: pd.Series, glued: pd.Series, limit: pd.Series, size: pd.Series) -> pd.Series:
    def one(t, sl, g, top, most):
        p = _prefix(t)
        heads = [i for i in range(len(t)) if i == 0 or sl[i] != sl[i - 1]] + [len(t)]
        starts, first = [], None
        for k, (a, b) in enumerate(zip(heads, heads[1:])):
            if first is not None and (p[b] - p[heads[first]] > top or k - first >= most):
                first = None
            if p[b] - p[a] > top and first is None:
                starts += [a + x for x in _pack_bundles(t[a:b], g[a:b], top)]
                continue
            if first is None:
                first = k
                starts.append(a)
        return starts
    return _rows(one, tokens, slide, glued, limit, size)


def _tokens(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: T.token_tenths(b["text"]))


def _ends(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: T.ends_sentence(b["text"]))


def _with_previous(blocks: Column, test) -> Column:
    """test(block, previous block) for every block; false for the first one."""
    return F.transform(blocks, lambda b, i: F.when(i == 0, False).otherwise(F.coalesce(
        test(b, F.get(blocks, i - 1)), F.lit(False))))


def _tenths(limit: float | Column) -> Column:
    return limit if isinstance(limit, Column) else F.lit(int(round(limit * 10)))


def general_starts(blocks: Column, limit: float, size: int = K.BLOCKS_PER_SEGMENT) -> Column:
    """Break before headings, after `size` blocks at a sentence end, or over budget; never
    inside a group, and back to the last good split point."""
    return _general(_tokens(blocks), F.transform(blocks, lambda b: b["type"] == "heading"), _ends(blocks),
                    _with_previous(blocks, lambda b, a: b["group_id"] == a["group_id"]), _tenths(limit), F.lit(size))


def subtitle_starts(blocks: Column, limit: float, size: int = K.CUES_PER_SEGMENT, gap: float = K.CUE_GAP_SECONDS) -> Column:
    """Break on a pause longer than `gap`, after `size` cues at a sentence end, or over budget."""
    return _budget(_tokens(blocks), _with_previous(blocks, lambda b, a: F.round(b["start_s"] - a["end_s"], 3) > gap),
                   _ends(blocks), _tenths(limit), F.lit(size))


def key_value_starts(blocks: Column, limit: float, size: int = K.BLOCKS_PER_SEGMENT) -> Column:
    """Break when the top-level namespace changes, after `size` blocks, or over budget. Keys
    without a namespace keep the one before them."""
    own = F.transform(blocks, lambda b: F.when(F.contains(b["key_path"], F.lit(".")), F.substring_index(b["key_path"], ".", 1)))
    changed = _namespace_changes(own)
    return _budget(_tokens(blocks), changed, F.transform(blocks, lambda b: F.lit(True)), _tenths(limit), F.lit(size))


@F.pandas_udf(BOOLS)
def _namespace_changes(names: pd.Series) -> pd.Series:
    def one(ns):
        s = pd.Series(list(ns), dtype=object)
        s = s.where(s.notna() & (s != ""))
        before = s.ffill().shift()
        return (s.notna() & before.notna() & (s != before)).tolist()
    return _rows(one, names)


def group_starts(blocks: Column, limit: float) -> Column:
    """Pack whole groups of consecutive blocks; a group over budget stays whole."""
    return _bundles(_tokens(blocks), _with_previous(blocks, lambda b, a: b["group_id"] == a["group_id"]), _tenths(limit))


def slide_starts(blocks: Column, limit: float, slides: int = K.SLIDES_PER_SEGMENT) -> Column:
    """Pack slides; a slide over budget is packed by its groups. Blocks must be in slide order, see
    in_slide_order()."""
    return _slides(_tokens(blocks), F.transform(blocks, lambda b: F.coalesce(b["slide"].cast("int"), F.lit(0))),
                   _with_previous(blocks, lambda b, a: b["group_id"] == a["group_id"]), _tenths(limit), F.lit(slides))


RULES = {"general": general_starts, "subtitle": subtitle_starts, "key_value": key_value_starts,
         "group": group_starts, "slide": slide_starts}
RULE_BY_TYPE = {"pptx": "slide", "srt": "subtitle", "vtt": "subtitle", "ass": "subtitle",
                **{t: "key_value" for t in ("json", "yaml", "yml", "po", "pot", "xliff", "xlf", "xml")}}


def in_slide_order(docs: DataFrame) -> Column:
    """The blocks of `docs` sorted by slide, keeping their order inside one. A block without a slide
    number takes it from `slide<number>` in its id, else it stands on slide 0; the number is filled in."""
    block = docs.schema["blocks"].dataType.elementType
    from_id = lambda b: F.try_element_at(F.regexp_extract_all(b["block_id"], F.lit(r"slide(\d+)"), F.lit(1)), F.lit(1)).cast("int")
    slide = lambda b: F.coalesce(b["slide"].cast("int"), *([from_id(b)] if "block_id" in block.names else []), F.lit(0))
    keyed = F.array_sort(F.transform("blocks", lambda b, i: F.struct(slide(b).alias("slide"), i.alias("i"), b.alias("b"))))
    return F.transform(keyed, lambda k: k["b"].withField("slide", k["slide"].cast(block["slide"].dataType)))


def cut(blocks: Column, starts: Column) -> Column:
    """Array of segments, each an array of blocks."""
    return T.let(starts, lambda at: F.transform(at, lambda s, k: F.slice(
        blocks, s + 1, F.coalesce(F.get(at, k + 1), F.size(blocks)) - s)))


def segment(docs: DataFrame, rule: str, limit: float, **options) -> DataFrame:
    """Add `segments` to documents with a `blocks` array."""
    docs = docs.withColumn("blocks", in_slide_order(docs)) if rule == "slide" else docs
    with_starts = docs.withColumn("_starts", RULES[rule](F.col("blocks"), limit, **options))
    return with_starts.withColumn("segments", cut(F.col("blocks"), F.col("_starts"))).drop("_starts")


def segment_by_type(docs: DataFrame, file_type: str = "file_type") -> DataFrame:
    """Choose rule and budget by file type in one pass; unknown types follow the general rule.

    Each rule sees the blocks of its own file types only, so no walk runs twice.
    """
    kind = F.lower(F.coalesce(F.col(file_type), F.lit("")))
    tenths = {t: int(round(n * 10)) for t, n in K.SEGMENT_TOKENS.items()}
    budget = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in tenths.items() for x in kv]), kind),
                        F.lit(tenths["default"]))
    rule = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RULE_BY_TYPE.items() for x in kv]), kind), F.lit("general"))
    out = (docs.withColumn("_rule", rule).withColumn("_budget", budget)
           .withColumn("blocks", F.when(F.col("_rule") == "slide", in_slide_order(docs)).otherwise(F.col("blocks"))))
    own = lambda name: F.when(F.col("_rule") == name, F.col("blocks")).otherwise(F.slice("blocks", 1, 0))
    starts = F.coalesce(*[F.when(F.col("_rule") == name, walk(own(name), F.col("_budget"))) for name, walk in RULES.items()])
    return out.withColumn("_starts", starts).withColumn("segments", cut(F.col("blocks"), F.col("_starts"))).drop("_starts", "_rule", "_budget")


def segment_rows(docs: DataFrame) -> DataFrame:
    """One row per segment: (doc_id, segment_no, blocks)."""
    return docs.select("doc_id", F.posexplode_outer("segments").alias("segment_no", "blocks")).where("blocks is not null")


def block_rows(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", "segment_no", F.explode_outer("blocks").alias("b")).select("doc_id", "segment_no", "b.*")


def joined_text(blocks: Column, field: str = "text") -> Column:
    return F.array_join(F.transform(blocks, lambda b: b[field]), "\n")


def next_previews(docs: DataFrame, chars: int = K.PREVIEW_CHARS) -> DataFrame:
    """(doc_id, segment_no, preview) with the start of the following segment's source."""
    seg = F.col("segments")
    previews = F.transform(seg, lambda s, k: F.when(k + 1 < F.size(seg), F.substring(joined_text(F.get(seg, k + 1)), 1, chars)))
    return docs.select("doc_id", F.posexplode_outer(previews).alias("segment_no", "preview")).where("segment_no is not null")


def previous_contexts(docs: DataFrame, texts: str = "translations", chars: int = K.CONTEXT_CHARS,
                      window: int = K.SEGMENTS_PER_WINDOW, filled: bool = False) -> DataFrame:
    """(doc_id, segment_no, context): the last characters translated before a segment's window.

    `texts` holds the translated text per segment, stripped; `filled` leaves out the rows of segments without
    one. The walk keeps one short string per window, with the blanks that a cut leaves at its start, so what is
    kept never falls short of the last characters.
    """
    seg = F.col(texts)
    step = lambda acc, t: F.when(t == "", acc).otherwise(
        F.right(F.when(acc == "", t).otherwise(F.concat(acc, F.lit("\n"), t)), F.lit(chars)))
    n = F.ceil(F.size(seg) / window).cast("int")
    groups = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                         lambda w: F.slice(seg, (w - 1) * window + 1, F.lit(window)))
    states = F.aggregate(groups, F.array(F.lit("")), lambda acc, g: F.concat(acc, F.array(
        F.aggregate(g, F.element_at(acc, -1), step))))
    rows = docs.select("doc_id", F.posexplode_outer(T.let(states, lambda held: F.transform(seg, lambda t, k: F.struct(
        F.get(held, F.floor(k / window).cast("int")).alias("context"), (t != "").alias("filled"))))).alias("segment_no", "s"))
    return rows.where("segment_no is not null" + (" and s.filled" if filled else "")).select("doc_id", "segment_no", "s.context")


@F.pandas_udf(INTS)
def _units(fixed: pd.Series) -> pd.Series:
    def one(values):
        out, nxt = [], 1
        for v in values:
            unit = nxt if v is None or v != v else int(v)
            out.append(unit)
            nxt = max(nxt, unit + 1)
        return out
    return _rows(one, fixed)


def unit_numbers(blocks: Column, file_type: str) -> Column:
    """Unit per block: slide, cue or paragraph number; blocks without one follow the largest so far."""
    if file_type == "pptx":
        fixed = F.transform(blocks, lambda b: (b["slide"] + 1).cast("int"))
    elif file_type in ("srt", "vtt", "ass"):
        fixed = F.transform(blocks, lambda b: b["cue"].cast("int"))
    elif file_type in ("docx", "doc"):
        fixed = F.transform(blocks, lambda b, i: i + 1)
    else:
        fixed = F.transform(blocks, lambda b: F.lit(None).cast("int"))
    return _units(fixed)


def unit_label(file_type: Column) -> Column:
    t = F.lower(file_type)
    return (F.when(t == "pptx", "slide").when(t.isin("srt", "vtt", "ass"), "subtitle")
            .when(t.isin("docx", "doc"), "paragraph").otherwise("block"))


def range_label(units: Column) -> Column:
    lo, hi = F.array_min(units), F.array_max(units)
    return F.when(F.size(units) == 0, "").when(lo == hi, lo.cast("string")).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))


def list_groups(docs: DataFrame) -> DataFrame:
    """Group id per block: consecutive items of one list share a group, anything else breaks it.

    Needs list_id and translatable in the block struct; blocks that are not translatable drop out.
    """
    b = F.col("blocks")
    head = _with_previous(b, lambda x, a: x["translatable"] & a["translatable"] & (x["list_id"] == a["list_id"]))
    starts = F.filter(F.transform(head, lambda glued, i: F.when(~glued, i)), lambda i: i.isNotNull())
    runs = T.let(starts, lambda at: F.transform(cut(b, at), lambda run, k: F.struct(F.get(at, k).alias("at"), run.alias("run"))))
    return (docs.select("doc_id", F.explode(runs).alias("r"))
            .select("doc_id", F.col("r.at").alias("at"), F.posexplode("r.run").alias("para_index", "b"))
            .where("b.translatable").select(
                "doc_id", "b.block_no", "para_index",
                F.concat(F.when(F.col("b.list_id").isNotNull(), "body_list_").otherwise("body_p_"), F.col("at")).alias("group_id"),
                F.when(F.col("b.list_id").isNotNull(), "body_list").otherwise("body_paragraph").alias("group_kind")))
