"""Helpers shared by the operators: tables, stored steps, blocks of large buckets, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept away from all training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def in_blocks(keyed: DataFrame, key: str, member: str, block: int, heavy: bool = False) -> DataFrame:
    """Rows of every bucket with at least two members, cut into groups of bounded size.

    With `heavy`, rows are wide and few stand alone: only the sizes of large buckets are looked up, so
    that rows move once, and those that stand alone come along.

    A bucket of up to `block` rows is one group. A larger one is cut into n blocks by a hash of the
    member, and every pair of blocks is a group, so any two rows of a bucket meet in exactly one
    group: in (b, b) if their block is the same, else in (b, c). Adds `lo`, `hi` (the blocks of the
    group) and `own` (the block of the row); rows arrive partitioned and sorted by group.
    """
    sizes = keyed.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > (block if heavy else 1))
    n = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(float(block))).cast("int")
    cut = (keyed.join(written(sizes, "large-buckets") if heavy else sizes, key, "left" if heavy else "inner")
           .withColumn("_blocks", n)
           .withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_blocks")).cast("int"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
           .withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other"))
           .drop("_n", "_blocks", "_other"))
    return cut.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def whole_groups(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted frames again, cut so that no group crosses a border, with the start of each group."""
    rest = None
    for frame in frames:
        if not len(frame):
            continue
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        starts = _starts(rest, columns)
        if len(starts) > 1:
            last = starts[-1]
            yield rest.iloc[:last], starts[:-1]
            rest = rest.iloc[last:].reset_index(drop=True)
    if rest is not None:
        yield rest, _starts(rest, columns)


def _starts(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    new[0] = True
    for c in columns:
        v = frame[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union-find over rows of one frame; `join` returns the pairs that connected two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        self.flatten()
        apart = self.root[a] != self.root[b]
        out = []
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out.append((i, j))
        return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    `edges` has the long columns a, b. Alternates two steps until nothing changes: every node links
    its larger neighbours to its smallest neighbour, then its smaller ones. Each step is a group
    minimum, which shrinks before the shuffle, and an equi join, whose skew the adaptive join splits.
    The number of rounds grows with the logarithm of the longest chain. Each round is stored, so a
    lost executor costs no more than the round that runs.
    """
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), name)
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = written(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        small = (moved.union(least.select("a", "m"))
                 .select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct())
        state = written(small, name)
        now = _mark(state)
        if now == mark:
            break
        mark = now
    top = state.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return top.union(top.select("component", "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.col("b").cast("decimal(19,0)"))).first())
