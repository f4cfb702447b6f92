"""Exchanging segments with a model as tables: payloads, replies, retries, review, cache.

A segment row holds its blocks as an array, so building a payload and reading a reply are
column expressions on that row. Only the model itself is a Python function over batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import constants as K
from ..functions import text as T
from ..session import settings, written
from ..skew import SALTS, fits_broadcast

#: Rows and bytes that a model is asked at once. A worker holds a batch several times over, as Arrow, as requests and as replies.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Copies of a request from which they are spread over tasks.
HOT = 10_000

Model = Callable[[pd.DataFrame], pd.Series]


def payload(blocks: Column, text: str = "text") -> Column:
    """`[[BLOCK:id]]` pieces with a comment whenever the group changes, closed by `[[END]]`."""
    def piece(b, i):
        g = b["group_id"]
        before = F.when(i > 0, F.get(blocks, i - 1)["group_id"])
        opens = g.isNotNull() & (g != "") & ~g.eqNullSafe(before)
        marked = F.concat(F.lit("[[BLOCK:"), b["block_id"], F.lit("]]\n"), F.coalesce(b[text], F.lit("")))
        return F.when(opens, F.concat(F.lit("<!-- group: "), g, F.lit(" -->\n"), marked)).otherwise(marked)
    return F.concat(F.array_join(F.transform(blocks, piece), "\n\n"), F.lit(f"\n\n{K.END_MARKER}"))


def _cut_at_end(reply: Column) -> Column:
    """Everything before the last line that is only the end marker."""
    return F.regexp_replace(reply, r"(?s)\A(?:(.*)\n)?[ \t]*\[\[END\]\][ \t]*(?=\n|\z).*\z", "$1")


def _clean(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, K.GROUP_COMMENT, ""))


def parse_reply(reply: Column, blocks: Column) -> Column:
    """array<struct<block_id, text>> of the expected blocks that the reply translates.

    Unknown ids are ignored and blank texts count as missing; of repeated ids the last wins. A
    lone block takes the whole reply when no marker matched.
    """
    def read(body):
        ids = F.regexp_extract_all(body, F.lit(K.BLOCK_MARKER), F.lit(1))
        pairs = F.filter(F.zip_with(ids, F.slice(F.split(body, K.BLOCK_MARKER), F.lit(2), F.size(ids)), lambda i, t: F.struct(
            i.alias("block_id"), _clean(t).alias("text"))), lambda p: p["text"] != "")
        found = T.let(pairs, lambda ps: F.filter(F.transform(blocks, lambda b: F.struct(
            b["block_id"].alias("block_id"),
            F.try_element_at(F.filter(ps, lambda p: p["block_id"] == b["block_id"]), F.lit(-1))["text"].alias("text"))),
            lambda x: x["text"].isNotNull()))
        cut = T.strip(F.substring_index(_clean(body), K.END_MARKER, 1))
        alone = F.array(F.struct(F.get(blocks, F.lit(0))["block_id"].alias("block_id"), cut.alias("text")))
        return T.let(found, lambda f: F.when((F.size(blocks) == 1) & (F.size(f) == 0) & (cut != ""), alone).otherwise(f))
    return T.let(_cut_at_end(reply), read)


def read_replies(segments: DataFrame) -> DataFrame:
    """Add `parsed` and `complete` to segments with `blocks` and `reply`."""
    out = segments.withColumn("parsed", parse_reply(F.col("reply"), F.col("blocks")))
    return out.withColumn("complete", F.size("parsed") == F.size("blocks"))


def match_ratios(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "segment_no", F.size("blocks").alias("expected"), F.size("parsed").alias("matched"),
                       (F.size("parsed") / F.size("blocks")).alias("ratio"))


def translations(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "segment_no", F.explode_outer("parsed").alias("p")).where("p is not null").select("doc_id", "segment_no", "p.*")


def missing_blocks(read: DataFrame) -> DataFrame:
    lost = F.filter("blocks", lambda b: ~F.exists("parsed", lambda p: p["block_id"] == b["block_id"]))
    return read.select("doc_id", "segment_no", F.explode_outer(lost).alias("b")).where("b is not null").select("doc_id", "segment_no", "b.block_id")


def call_model(requests: DataFrame, model: Model, needs: list[str]) -> DataFrame:
    """Add `reply` by sending batches of the needed columns to a model function. The other columns
    stay in the JVM. Whoever stores the replies does so under the settings `BATCH`."""
    @F.pandas_udf(StringType())
    def ask(rows: pd.DataFrame) -> pd.Series:
        return model(rows)
    return requests.withColumn("reply", ask.asNondeterministic()(F.struct(*needs)))


def echo_model(requests: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in: puts `[T]` before the text of every block."""
    return requests["payload"].str.replace(r"(\[\[BLOCK:[\w\-]+\]\]\n)", r"\1[T]", regex=True)


def translate(segments: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Translate segments; returns (translations, failures).

    A segment with missing blocks is asked again as a whole; if blocks are still missing, each of
    its blocks is asked alone, twice at most. Replies of a pass are stored before they are read,
    so a lost executor never repeats a request that was answered.
    """
    def ask(rows, attempt):
        sent = rows.withColumn("payload", payload(F.col("blocks"))).withColumn("attempt", F.lit(attempt))
        replied = call_model(sent, model, ["doc_id", "segment_no", "payload", "attempt"])
        with settings(rows.sparkSession, BATCH):
            read = written(read_replies(replied).select("doc_id", "segment_no", "blocks", "parsed", "complete"), "replies")
        return (read.where("complete").withColumn("pass", F.lit(attempt)),
                read.where("not complete").select("doc_id", "segment_no", "blocks"))

    ok1, open1 = ask(segments.select("doc_id", "segment_no", "blocks"), 1)
    ok2, open2 = ask(open1, 2)
    singles = open2.select("doc_id", "segment_no", F.explode(F.transform("blocks", lambda b: F.array(b))).alias("blocks"))
    ok3, open3 = ask(singles, 3)
    ok4, open4 = ask(open3, 4)
    good = ok1.unionByName(ok2).unionByName(ok3).unionByName(ok4)
    done = good.select("doc_id", "segment_no", "pass", F.explode("parsed").alias("p")).select(
        "doc_id", "segment_no", "p.block_id", F.col("p.text").alias("translated_text"), "pass")
    failed = open4.select("doc_id", "segment_no", F.get(F.col("blocks.block_id"), F.lit(0)).alias("block_id"))
    return done, failed


def review_changes(read: DataFrame) -> DataFrame:
    """Change records of a review pass over drafts; blocks the reviewer lost keep their draft.

    Blocks need `text` (the draft) and `source_text`."""
    after = lambda b: F.coalesce(F.try_element_at(F.filter("parsed", lambda p: p["block_id"] == b["block_id"]), F.lit(-1))["text"], b["text"])
    rows = read.select("doc_id", "segment_no", F.explode_outer(F.transform(F.filter("blocks", lambda b: b["text"] != ""), lambda b: F.struct(
        b["block_id"].alias("block_id"), b["source_text"].alias("source_text"), b["text"].alias("before"), after(b).alias("after")))).alias("c")).where("c is not null")
    changed = F.col("before") != F.col("after")
    return (rows.select("doc_id", "segment_no", "c.*").withColumn("changed", changed)
            .withColumn("source_text", F.when(changed, F.col("source_text")).otherwise(""))
            .withColumn("before", F.when(changed, F.col("before")).otherwise("")))


def merge_blocks(blocks: DataFrame, translated: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Put translated and reviewed texts back on all blocks; blank ones leave a block as it is."""
    keys = ["doc_id", "block_id"]
    t = translated.where("translated_text <> ''").select(*keys, "translated_text")
    r = reviewed.where("reviewed_text <> ''").select(*keys, "reviewed_text")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return blocks.join(t, keys, "left").join(r, keys, "left").select(*blocks.columns, blank("translated_text"), blank("reviewed_text"))


# --- cache ------------------------------------------------------------------------------------

def answer(requests: DataFrame, cache: DataFrame, model: Model, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Answer requests from the cache, ask the model once per distinct uncached request.

    Returns (answered requests with `hit`, new cache rows). The key is a hash of the request, so
    many copies of one request become one row before anything is asked or joined.
    """
    keyed = requests.withColumn("request_key", T.request_key(*key_cols))
    distinct = keyed.groupBy("request_key").agg(F.min(F.struct(*key_cols)).alias("q")).select("request_key", "q.*")
    replied = call_model(distinct.join(cache, "request_key", "left_anti"), model, key_cols).select("request_key", "reply")
    with settings(requests.sparkSession, BATCH):
        new = written(replied, "cache")
    known = cache.select("request_key", "reply", F.lit(True).alias("hit")).unionByName(new.withColumn("hit", F.lit(False)))
    return _join_copies(keyed, known), new


def _join_copies(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Replies put on their requests. Most requests stand alone, so a reply is repeated for other tasks only
    where its request has HOT copies or more."""
    if fits_broadcast(known):
        return keyed.join(F.broadcast(known), "request_key")
    hot = F.broadcast(keyed.groupBy("request_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= HOT).select(
        "request_key", F.lit(SALTS).alias("_salts")))
    spread = F.xxhash64(*[c for c in keyed.columns if c != "request_key"])
    left = keyed.join(hot, "request_key", "left").withColumn("_salt", F.pmod(spread, F.coalesce("_salts", F.lit(1))).cast("int"))
    right = known.join(hot, "request_key", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return left.drop("_salts").join(right.drop("_salts"), ["request_key", "_salt"]).drop("_salt")


def system_prompt(template: Column, values: dict[str, Column]) -> Column:
    """Fill `{name}` fields of a template."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{%s}" % name), F.coalesce(value, F.lit("")))
    return out


# --- differences ------------------------------------------------------------------------------

#: Bytes of position masks that a comparison keeps; the masks of rarer tokens are made when needed.
MASK_BYTES = 32_000_000


def edit_path(x: list, y: list) -> bytes:
    """Steps that turn x into y by their longest common subsequence: `=` keep, `-` delete, `+` insert.

    Where both directions are open, an insertion is the last step (as seen from the end). A row of the
    table of lengths is one whole number, whose bit j is 0 where the length grows at place j, and a row
    follows from the row above by one addition. Seen from a cell whose tokens differ, the last step is an
    insertion exactly where the length does not grow, so these bits are all that is needed. Every
    sqrt(m)-th row is kept; the rows between are made again as the path comes to them.
    """
    same = 0
    while same < min(len(x), len(y)) and x[-1 - same] == y[-1 - same]:
        same += 1
    m, n = len(x) - same, len(y) - same
    places: dict = {}
    for j in range(n):
        places.setdefault(y[j], []).append(j)
    size = n // 8 + 1
    kept = {}
    for token in sorted(places, key=lambda t: -len(places[t]))[:MASK_BYTES // size]:
        kept[token] = _mask(places[token], size)
    whole = (1 << n) - 1

    def below(row, token):
        at = kept.get(token)
        if at is None:
            at = _mask(places[token], size) if token in places else 0
        both = row & at
        return ((row + both) | (row - both)) & whole

    step = max(1, math.isqrt(m))
    marks, row = [], whole
    for i in range(m):
        if i % step == 0:
            marks.append(row)
        row = below(row, x[i])
    out, j = [b"=" * same], n
    for start in range((len(marks) - 1) * step, -1, -step):
        rows, row = [], marks.pop()
        for i in range(start, min(start + step, m)):
            row = below(row, x[i])
            rows.append(row.to_bytes(size, "little"))
        i = len(rows)
        while i and j:
            if x[start + i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.append(b"=")
            elif rows[i - 1][(j - 1) >> 3] >> ((j - 1) & 7) & 1:
                j -= 1
                out.append(b"+")
            else:
                i -= 1
                out.append(b"-")
        out.append(b"-" * i)
    out.append(b"+" * j)
    return b"".join(reversed(out))


def _mask(places: list[int], size: int) -> int:
    bits = np.zeros(size * 8, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


STEP_NAMES = {ord("="): "equal", ord("-"): "delete", ord("+"): "insert"}


def edit_steps(x: list[str], y: list[str]) -> list[tuple[str, str]]:
    """Runs of equal steps with their text."""
    path = np.frombuffer(edit_path(x, y), np.uint8)
    if not len(path):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
    in_x, in_y = (np.concatenate([[0], np.cumsum(path != ord(c))])[cuts].tolist() for c in "+-")
    return [(STEP_NAMES[op], "".join(y[c:d] if op == ord("+") else x[a:b]))
            for op, a, b, c, d in zip(path[cuts[:-1]].tolist(), in_x, in_x[1:], in_y, in_y[1:], strict=False)]


def token_diff(changes: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """Merged word-level edit steps of every pair: (keys, step, op, text), on ties as `edit_path` has it.

    A longest common subsequence needs a walk over both texts, which no built-in gives; a pair takes
    a few rows of bits, so two texts of 100,000 tokens take some 10 MB. A null text is empty.
    """
    def run(batches):
        for pdf in batches:
            rows = [(*r[:len(keys)], n, op, text) for r in pdf.itertuples(index=False)
                    for n, (op, text) in enumerate(edit_steps(list(r.a_words), list(r.b_words)))]
            yield pd.DataFrame(rows, columns=[*keys, "step", "op", "text"])

    words = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*|\s+|[^\p{L}\p{N}_\s]"), F.lit(0))
    tokens = changes.select(*keys, words(before).alias("a_words"), words(after).alias("b_words"))
    fields = [f for f in tokens.schema.fields if f.name in keys]
    schema = StructType(fields + [StructField("step", IntegerType()), StructField("op", StringType()), StructField("text", StringType())])
    return tokens.mapInPandas(run, schema)


def marked_diff(steps: DataFrame, keys: list[str]) -> DataFrame:
    """`<ins>`/`<del>` text of every pair. Steps of one pair come from one block."""
    esc = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    piece = (F.when(F.col("op") == "insert", F.concat(F.lit("<ins>"), esc, F.lit("</ins>")))
             .when(F.col("op") == "delete", F.concat(F.lit("<del>"), esc, F.lit("</del>"))).otherwise(esc))
    return steps.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("step", piece.alias("piece")))), lambda x: x["piece"]), "").alias("diff"))


def changed_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    real = F.coalesce(F.col("changed"), F.lit(True)) & (F.col("before") != F.col("after"))
    return changes.groupBy(*keys).agg(F.count_if(real).alias("changed_blocks"), F.count("*").alias("blocks"))
