"""Hard-negative mining with an STR-packed R-tree.

Vectors of whole numbers are packed sort-tile-recursive: Spark deals them out by ranges of two coordinates
into tiles of bounded size, and a task packs the vectors of a tile by the next coordinates into leaves and
nodes. A node's minimum bounding box gives an interval for the inner product with a query, coordinate by
coordinate. Queries go through a tile best first, in blocks: the node with the highest upper bound is
opened next, and a query leaves a node whose interval lies outside its score window or strictly below
the k-th score it has (an equal score may still win by its id).
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import whole_groups

SCALE = 256
#: Positives of an anchor, and negatives of an anchor and positive.
POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score, in hundredths, in which a negative's score lies.
WINDOW = (50, 95)
#: Vectors of a tile, queries that meet a tile in one group, vectors of a leaf, children of a node.
TILE, QUERIES, LEAF, FANOUT = 8192, 4096, 64, 8
#: Queries that go through a tile together.
TOGETHER = 256
LEAST, MOST = -(2 ** 63), 2 ** 63 - 1


def whole_vectors(vectors: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(vec_id, label, vector, size): floor(SCALE * x) of each component, as 8-byte little-endian
    numbers in one binary value. Null labels, vectors, components and non-finite ones leave a row out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = (vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.forall(embedding, finite))
             .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                     F.transform(embedding, lambda x: x.cast("double")).alias("v"))
             .groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))

    def packed(frames):
        for f in frames:
            vector = [np.floor(SCALE * np.asarray(v, float)).clip(LEAST, MOST).astype("<i8").tobytes() for v in f["v"]]
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "vector": vector, "size": [len(v) // 8 for v in vector]})
    return whole.mapInPandas(packed, "vec_id long, label long, vector binary, size int")


def _coordinate(vector: bytes, i: int) -> int:
    v = np.frombuffer(vector, "<i8")
    return int(v[i % len(v)]) if len(v) else 0


def tiles(vectors: DataFrame, n: int) -> DataFrame:
    """Vectors with the number of their tile: slabs of the first coordinate, in each of them ranges of
    the second; vectors of different length never share a box. Ranges are cut by Spark and stored with
    the rows, so a rebuilt task sees the same tiles; neighbouring ranges are one tile up to about TILE
    vectors, all tiles of about one size, however many partitions there are."""
    count = max(1, math.ceil(n / TILE))
    slabs = math.ceil(math.sqrt(count))

    def first_two(frames):
        for f in frames:
            for i in (0, 1):
                f[f"c{i}"] = [_coordinate(v, i) for v in f["vector"]]
            yield f
    two = vectors.mapInPandas(first_two, "vec_id long, label long, vector binary, size int, c0 long, c1 long")
    slab = two.repartitionByRange(slabs, "size", "c0", "vec_id").withColumn("slab", F.spark_partition_id())
    dealt = written(written(slab, "rtree-slabs").repartitionByRange(count, "slab", "size", "c1", "vec_id")
                    .withColumn("range", F.spark_partition_id()), "rtree-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    numbers = dealt.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / math.ceil(max(n, 1) / count)).cast("int").alias("tile"))
    return dealt.join(numbers, "range").select("tile", "size", "vec_id", "label", "vector")


class Tree:
    """R-tree over the rows of a matrix; node 0 is the root. Boxes have a last coordinate for the label."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.order = np.arange(len(vectors))
        levels = [self._leaves(vectors)]
        points = np.column_stack([vectors, labels])
        at = levels[0]
        low = np.minimum.reduceat(points[self.order], at[:-1])
        high = np.maximum.reduceat(points[self.order], at[:-1])
        boxes = [(low, high)]
        while len(boxes[-1][0]) > 1:
            low, high = boxes[-1]
            cut = np.arange(0, len(low), FANOUT)
            levels.append(np.append(cut, len(low)))
            boxes.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.levels, self.boxes = levels, boxes

    def _leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Sort-tile-recursive over coordinates 2, 3, ...: every sort cuts slabs along one more coordinate."""
        n, d = vectors.shape
        groups, c = [np.arange(n)], 2
        while max(map(len, groups)) > LEAF:
            out = []
            for g in groups:
                if len(g) <= LEAF:
                    out.append(g)
                    continue
                g = g[np.argsort(vectors[g, c % d] if d else np.zeros(len(g)), kind="stable")]
                step = LEAF * math.ceil(math.ceil(len(g) / LEAF) / FANOUT)
                out += [g[i:i + step] for i in range(0, len(g), step)]
            groups, c = out, c + 1
        self.order = np.concatenate(groups)
        return np.append(0, np.cumsum([len(g) for g in groups]))


def _product(a: np.ndarray, b: np.ndarray, exact_below: float) -> np.ndarray:
    """Inner products of rows, exact: in floats where every partial sum is, else with Python's numbers."""
    if exact_below < 2 ** 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if exact_below < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def _interval(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of queries with boxes, (queries, boxes), with room for rounding."""
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    below, above = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    room = 1e-12 * (np.abs(plus) @ np.abs(high).T + np.abs(minus) @ np.abs(high).T + np.abs(plus) @ np.abs(low).T + np.abs(minus) @ np.abs(low).T)
    return below - room, above + room


def search(tree: Tree, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, queries: np.ndarray, q_labels: np.ndarray,
           low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best k scores and ids of every query, (queries, k), among the rows of its own label (`same`) or of
    others whose score is in [low, high]; missing places have the id MOST and the score LEAST."""
    n, d = len(queries), vectors.shape[1]
    best, found = np.full((n, k), LEAST), np.full((n, k), MOST)
    full = np.zeros(n, bool)
    limit = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, d)
    number = itertools.count()
    heap: list = []

    def push(level, nodes, active):
        lo, hi = tree.boxes[level]
        below, above = _interval(lo[nodes, :d], hi[nodes, :d], queries[active])
        q = q_labels[active][:, None]
        first, last = lo[nodes, d][None], hi[nodes, d][None]
        fits = (first <= q) & (q <= last) if same else ~((first == q) & (last == q))
        # As numbers with rounding the bounds are compared with floats, which never hides a whole score.
        fits &= (below <= high[active][:, None].astype(float)) & (above >= low[active][:, None].astype(float))
        fits &= ~full[active][:, None] | (above >= best[active, -1].astype(float)[:, None])
        for j in np.flatnonzero(fits.any(axis=0)):
            rows = fits[:, j]
            heapq.heappush(heap, (-above[rows, j].max(), next(number), level, int(nodes[j]), active[rows], above[rows, j]))

    push(len(tree.levels) - 1, np.array([0]), np.arange(n))
    while heap:
        _, _, level, node, active, above = heapq.heappop(heap)
        active = active[~full[active] | (above >= best[active, -1].astype(float))]
        if not len(active):
            continue
        a, b = tree.levels[level][node:node + 2]
        if level:
            push(level - 1, np.arange(a, b), active)
            continue
        rows = tree.order[a:b]
        scores = _product(queries[active], vectors[rows], limit)
        mine = labels[rows][None] == q_labels[active][:, None]
        fits = (mine if same else ~mine) & (scores >= low[active][:, None]) & (scores <= high[active][:, None])
        some = fits.any(axis=1)
        if not some.any():
            continue
        active, scores, fits = active[some], scores[some], fits[some]
        every = np.concatenate([best[active], np.where(fits, scores, LEAST)], axis=1)
        names = np.concatenate([found[active], np.where(fits, ids[rows][None], MOST)], axis=1)
        # Highest score first (written as ~score, which does not overflow), then the smallest id.
        top = np.lexsort((names, ~every), axis=1)[:, :k]
        best[active], found[active] = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)
        full[active] = found[active, -1] != MOST
    return best, found


def _answers(frames: Iterator[pd.DataFrame], k: int, same: bool) -> Iterator[pd.DataFrame]:
    """Groups of (tile, part): rows without a query number are the tile's vectors, the others its queries."""
    tree, of = None, None
    for frame, starts in whole_groups(frames, ["tile", "part", "size"]):
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            group = frame.iloc[s:e]
            size = int(group["size"].iloc[0])
            matrix = np.frombuffer(b"".join(group["vector"]), "<i8").reshape(len(group), size)
            asks = group["query"].to_numpy() >= 0
            if asks.all() or not asks.any():
                continue
            ids, labels = group["vec_id"].to_numpy(), group["label"].to_numpy()
            v, v_ids, v_labels = matrix[~asks], ids[~asks], labels[~asks]
            key = (int(group["tile"].iloc[0]), size)
            if of != key:
                tree, of = Tree(v, v_labels), key
            q, q_labels, q_ids = matrix[asks], labels[asks], group["query"].to_numpy()[asks]
            low, high = group["low"].to_numpy()[asks], group["high"].to_numpy()[asks]
            for c in range(0, len(q), TOGETHER):
                at = slice(c, c + TOGETHER)
                best, found = search(tree, v, v_labels, v_ids, q[at], q_labels[at], low[at], high[at], k, same)
                i, j = np.nonzero(found != MOST)
                if len(i):
                    yield pd.DataFrame({"query": q_ids[at][i], "low": low[at][i], "high": high[at][i],
                                        "score": best[i, j], "vec_id": found[i, j]})


def nearest(packed: DataFrame, n_tiles: int, queries: DataFrame, n_queries: int, k: int, same: bool) -> DataFrame:
    """(query, low, high, place, score, vec_id): the first k rows of every query (query, label, vector,
    size, low, high) over all tiles. Queries are cut into parts; every part meets every tile once, where
    its first k rows are found, and the first k of those are the answer."""
    parts = max(1, math.ceil(n_queries / QUERIES))
    columns = ["tile", "part", "size", "query", "vec_id", "label", "vector", "low", "high"]
    rows = (packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("query", F.lit(-1).cast("long"))
            .withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(0).cast("long")))
    asks = (queries.withColumn("part", F.pmod(F.xxhash64("query", "low", "high"), F.lit(parts)).cast("int")).withColumn("vec_id", F.lit(-1).cast("long"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))))
    met = (rows.select(columns).union(asks.select(columns)).repartition("tile", "part")
           .sortWithinPartitions("tile", "part", "size", "query", "vec_id"))
    found = met.mapInPandas(lambda it: _answers(it, k, same), "query long, low long, high long, score long, vec_id long")
    first = F.row_number().over(Window.partitionBy("query", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", first).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchor_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor (an id
    divisible by `anchor_every`) and each of its first `positives` other rows of the same label, the first
    `negatives` rows of other labels whose score is within `window` hundredths of the positive's, both
    borders included. Scores are inner products of floor(256 * component); higher ones come first, then
    smaller ids.

    Rows with a null id, label, vector or component or a non-finite component take no part; rows of one
    id count as one, the smallest label and vector. Vectors of different length are not compared, empty
    ones have score 0. A score beyond a long is its border. Equal vectors of one label are kept `positives`
    + 1 times for the search, those with the smallest ids, since no answer can name more of them, and
    equal anchors are searched once. Other columns are not read; an empty table gives an empty result.
    """
    base = written(whole_vectors(vectors, vec_id, label, embedding), "mining-vectors")
    copy = F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))
    most = max(positives + 1, negatives)
    rows = written(base.withColumn("_copy", copy).where(F.col("_copy") <= most).drop("_copy"), "mining-rows")
    packed = written(tiles(rows, rows.count()), "rtree-tiles")
    n_tiles = (packed.agg(F.max("tile")).first()[0] or 0) + 1
    anchors = base.where(F.col("vec_id") % anchor_every == 0)
    classes = written(anchors.groupBy("label", "vector", "size").agg(F.min("vec_id").alias("query")), "mining-anchors")
    free = classes.withColumn("low", F.lit(LEAST).cast("long")).withColumn("high", F.lit(MOST).cast("long"))
    near = nearest(packed, n_tiles, free, classes.count(), positives + 1, True).select("query", "score", F.col("vec_id").alias("positive_id"))
    near = written(near, "mining-positives")
    # 100 * score lies within window * positive; whole numbers, so the borders are a ceiling and a floor.
    score = F.col("score").cast("decimal(38,0)")
    low = F.ceil(score * window[0] / F.lit(100).cast("decimal(3,0)")).cast("long")
    high = F.floor(score * window[1] / F.lit(100).cast("decimal(3,0)")).cast("long")
    asks = near.select("query", low.alias("low"), high.alias("high")).where("low <= high").distinct()
    asks = written(asks.join(classes, "query"), "mining-windows")
    hard = written(nearest(packed, n_tiles, asks, asks.count(), negatives, False)
                   .select("query", "low", "high", "place", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id")), "mining-negatives")
    named = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "vector").join(classes, ["label", "vector"]).select("anchor_id", "query")
    pairs = named.join(near, "query").where("anchor_id <> positive_id")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    pairs = pairs.withColumn("_place", first).where(F.col("_place") <= positives)
    return (pairs.withColumn("low", low).withColumn("high", high).join(hard, ["query", "low", "high"])
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id",
                    F.col("score").alias("positive_score"), "negative_score"))
