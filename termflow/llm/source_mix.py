"""Mixing sources to target weights by the cube method.

A document of a source is taken floor(e) times for sure and once more with probability e - floor(e), where
e is the source's target over its size. Those fractions are decided by balanced sampling: the flight phase
moves the fractions of three undecided documents along the null space of the two balancing constraints
(sum of documents, sum of words), so both totals stay exactly as they are while one document after the
other is decided. Blocks of documents fly apart from each other; what is left of them, two documents of a
block at most, flies again in fewer blocks until one block of a source is left. Its last two documents are
the landing problem, solved as the linear programme that keeps both fractions and departs least in words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..skew import global_rank, salted_join
from .common import whole_groups

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Most often that a document is taken.
REPEATS = 3
#: Documents that fly together.
BLOCK = 2000
#: Fractions closer than this to 0 or 1 are decided.
NEAR = 1e-9


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Target of every row of `sizes` (missing, source, source_size, ...): the sum of all sizes shared by
    weight, with the excess over `repeats` times a size shared again until no target is above.

    Places of sources come from a global rank, and every pass over the sources returns two sums, so
    their number is not bounded by one task or the driver. Sources with no words get 0.
    """
    place = global_rank(sizes, [F.col("missing"), F.col("source")], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    base = written(place.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats), "mix-sources")
    whole, total_weight = base.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, shared, above = whole or 0, total_weight or 0, None
    exact = lambda c: c.cast("decimal(19,0)")  # products of sums and weights may be longer than a long

    def is_full() -> Column:
        return exact(F.col("most")) * exact(F.lit(shared)) <= exact(F.lit(rest)) * exact(F.col("weight"))
    while shared:
        full = is_full()
        n, filled, freed = base.agg(*[F.coalesce(F.sum(F.when(full, c)), F.lit(0)) for c in (F.lit(1), F.col("most"), F.col("weight"))]).first()
        if n == above:
            break
        above, rest, shared = n, whole - filled, total_weight - freed
    part = F.lit(float(rest)) * F.col("weight") / F.lit(float(shared or 1))
    return base.withColumn("target", F.when(is_full(), F.col("most").cast("double")).otherwise(part)).drop("place", "weight", "most")


def flight(fractions: list[float], sizes: list[int], draw, last: bool) -> list[float]:
    """Fractions after the flight phase: all 0 or 1 but for two at most; with `last` those land as well.

    In every step the fractions of three documents move along the null vector of ((1, 1, 1), their
    sizes), forth or back, as far as they stay in [0, 1]; the way is drawn so that every expectation
    stays as it was. Documents come with the large ones first, and the two first undecided ones fly with
    the last: a large document hardly moves beside two of like size, so what lands is of middle size.
    """
    p = [0.0 if f < NEAR else 1.0 if f > 1 - NEAR else f for f in fractions]
    at = [i for i in range(len(p)) if p[i] not in (0.0, 1.0)]
    front, back, large, small = 0, len(at) - 1, [], []
    while True:
        while front <= back and len(large) + len(small) < 3:
            if len(large) < 2:
                large.append(at[front])
                front += 1
            else:
                small.append(at[back])
                back -= 1
        three = large + small
        if len(three) < 3:
            break
        _step(p, three, _null([sizes[k] for k in three]), draw)
        large = [k for k in large if p[k] not in (0.0, 1.0)]
        small = [k for k in small if p[k] not in (0.0, 1.0)]
    if last:
        _land(p, three, sizes, draw)
    return p


def _null(s: list[int]) -> list[float]:
    """A direction that changes neither the number nor the words of three documents."""
    a, b, c = s
    if a == b == c:
        return [1.0, -1.0, 0.0]
    scale = max(abs(b - c), abs(c - a), abs(a - b))
    return [(b - c) / scale, (c - a) / scale, (a - b) / scale]


def _step(p: list[float], at: list[int], u: list[float], draw) -> None:
    forth, back = [((1 - p[k]) / d if d > 0 else p[k] / -d) for k, d in zip(at, u, strict=True) if d], \
                  [(p[k] / d if d > 0 else (1 - p[k]) / -d) for k, d in zip(at, u, strict=True) if d]
    f, b = min(forth), min(back)
    step = f if draw() * (f + b) < b else -b
    for k, d in zip(at, u, strict=True):
        x = p[k] + step * d
        p[k] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x


def _land(p: list[float], left: list[int], sizes: list[int], draw) -> None:
    """Decide two documents at most. The squared departure in words is least, among all distributions
    with these fractions, where as few as can be take both or neither; then only its draw remains."""
    if len(left) == 2:
        i, j = left
        both = max(0.0, p[i] + p[j] - 1)
        r = draw()
        if r < both:
            p[i] = p[j] = 1.0
        elif r < p[i]:
            p[i], p[j] = 1.0, 0.0
        elif r < p[i] + p[j] - both:
            p[i], p[j] = 0.0, 1.0
        else:
            p[i] = p[j] = 0.0
    elif left:
        p[left[0]] = 1.0 if draw() < p[left[0]] else 0.0


def _fly(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_groups(frames, ["missing", "source", "block"]):
        # Rows of one document and size stand as one row with their number until here.
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            group = frame.iloc[s:e]
            group = group.iloc[np.repeat(np.arange(e - s), group["n"].to_numpy())].reset_index(drop=True)
            first = group.iloc[0]
            seed = zlib.crc32(f"{first['missing']}:{first['block']}:{first['blocks']}:{first['source']}".encode())
            draw = np.random.default_rng(seed).random
            group["fraction"] = flight(group["fraction"].tolist(), group["size"].tolist(), draw, first["blocks"] == 1)
            group["n"] = 1
            yield group


def _in_blocks(items: DataFrame, level: int) -> DataFrame:
    """Items of a source dealt into its blocks by a hash; large documents come first in a block."""
    block = F.pmod(F.xxhash64("doc_id", "size", "piece", F.lit(level)), F.col("blocks")).cast("int")
    return (items.withColumn("block", block).repartition("missing", "source", "block")
            .sortWithinPartitions("missing", "source", "block", F.desc("size"), "doc_id", "piece"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: how many of its words the mix takes.

    Sources are ordered by code point, null (a source of its own) last, and share the sum of all sizes by
    the repeating weights, at most `repeats` times their own size. `taken` is a whole multiple of the
    size, at most `repeats` times it. A source's words depart from its target by less than one of its
    documents, one of middle size as a rule, since large documents are decided early. Every draw comes from
    a hash of source and block, so reruns agree.

    A null or blank text has size 0 and takes 0 words. Null and repeated ids are rows like others;
    rows of one id, source and size are counted before they move and fly as rows of their own. Empty
    tables give an empty result; other columns are not read. A source that holds most rows flies in many blocks.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("missing"),
                       F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), words(F.col(text)).alias("size"))
    items = written(rows.groupBy("missing", "source", "doc_id", "size").agg(F.count("*").alias("n")), "mix-items")
    sums = items.groupBy("missing", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    aims = targets(sums, weights, repeats).withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    aims = written(aims.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).cast("int")), "mix-targets")
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)))
    cut = cut.withColumn("n", F.least(F.lit(BLOCK), F.col("n") - F.col("piece") * BLOCK))
    state = (salted_join(cut, aims.drop("rows"), ["missing", "source"], ["doc_id", "size", "piece"])
             .withColumn("sure", F.floor("copies").cast("int")).withColumn("fraction", F.col("copies") - F.col("sure")).drop("copies"))
    most = aims.agg(F.max("blocks")).first()[0] or 1
    decided, level = [], 0
    while True:
        dealt = _in_blocks(state, level)
        flown = written(dealt.mapInPandas(_fly, dealt.schema), f"mix-flight-{level}").drop("block")
        done = F.col("fraction").isin(0.0, 1.0)
        decided.append(flown.where(done))
        if most == 1:
            break
        # Every block leaves two documents at most, which bounds the blocks of the next flight.
        most, level = math.ceil(2 * most / BLOCK), level + 1
        state = (flown.where(~done).withColumn("blocks", F.ceil(2 * F.col("blocks") / BLOCK).cast("int"))
                 .withColumn("piece", F.hash("piece", "fraction")))
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("sure") + F.col("fraction"))).cast("long").alias("taken"))
