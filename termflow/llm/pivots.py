"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots). Inverted lists are kept for pairs of
pivots, so what meets in a list shares at least two; pairs with enough shared pivots are verified by
their cosine in double precision, each only in the list of its two smallest shared pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import Forest, components, in_blocks, whole_groups

COSINE = 0.95
#: Nearest pivots that describe a vector.
NEAREST = 5
#: Pivots: about the square root of the number of vectors, within these bounds, taken from the vectors.
MIN_PIVOTS, MAX_PIVOTS = 32, 4096
#: Cosine from which a sampled vector is no further pivot.
APART = 0.8
BLOCK = 1000


def pivots_for(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Reference points by dimension, out of a bounded sample of 2n vectors chosen by a hash of their id.
    Of points within APART of each other one is taken, so a crowd of near copies is one reference and
    its members agree on the others. A dimension with too few gets fixed random directions as well."""
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(2 * n).select("embedding").collect()
    out: dict[int, list] = {}
    for r in sample:
        v = _unit(np.asarray(r.embedding)[None])[0]
        taken = out.setdefault(len(v), [])
        if len(taken) < n and (not taken or (np.array(taken) @ v).max() < APART):
            taken.append(v)
    return {d: _filled(np.array(rows), d, n) for d, rows in out.items()}


def _filled(rows: np.ndarray, dim: int, n: int) -> np.ndarray:
    if len(rows) >= n:
        return rows[:n]
    more = np.random.default_rng(dim).standard_normal((n - len(rows), dim))
    more /= np.linalg.norm(more, axis=1, keepdims=True)
    return np.vstack([rows, more]) if len(rows) else more


def _matrix(column: pa.ListArray, at: np.ndarray, dim: int) -> np.ndarray:
    """Rows `at` of a list column, all of length dim, in its own precision."""
    flat = column.values.to_numpy(zero_copy_only=False)
    return flat[column.offsets.to_numpy()[at][:, None] + np.arange(dim)]


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    v = v.astype(float)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares of very large or small components are exact
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _describe(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    pairs = np.array([(i, j) for i in range(NEAREST) for j in range(i + 1, NEAREST)]).reshape(-1, 2)
    for batch in batches:
        ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        dims = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            v = _matrix(batch.column(2), at, int(dim))
            points = pivots.get(int(dim))
            points = _filled(np.zeros((0, int(dim))), int(dim), n) if points is None else points
            close = np.sort(np.argsort(-(_unit(v) @ points.T), axis=1, kind="stable")[:, :NEAREST], axis=1)
            key = (int(dim) << 40) + close[:, pairs[:, 0]] * len(points) + close[:, pairs[:, 1]]
            repeat = np.repeat(np.arange(len(at)), len(pairs))
            near = close.astype("<i4").tobytes()
            raw = v.tobytes()
            a, b = NEAREST * 4, int(dim) * v.itemsize
            nears = [near[i * a:(i + 1) * a] for i in range(len(at))]
            raws = [raw[i * b:(i + 1) * b] for i in range(len(at))]
            for cut in range(0, len(repeat), 20_000):
                r = repeat[cut:cut + 20_000]
                yield pa.record_batch([pa.array(key.reshape(-1)[cut:cut + 20_000]), pa.array(ids[at][r]),
                                       pa.array(copies[at][r]), pa.array([nears[i] for i in r], pa.binary()),
                                       pa.array([raws[i] for i in r], pa.binary())],
                                      names=["key", "vec_id", "copies", "near", "vector"])


def _verify(frames: Iterator[pd.DataFrame], kind: str, n: int, least: float, shared: int) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_groups(frames, ["key", "lo", "hi"]):
        ends = [*starts[1:].tolist(), len(frame)]
        ids, copies, own, key = (frame[c].to_numpy() for c in ("vec_id", "copies", "own", "key"))
        crossing = (frame["lo"] != frame["hi"]).to_numpy()
        near = np.frombuffer(b"".join(frame["near"]), "<i4").reshape(len(frame), NEAREST)
        raws = frame["vector"].tolist()
        found_a, found_b, found_n = [], [], []
        for s, e in zip(starts.tolist(), ends, strict=True):
            if e - s == 1:
                continue
            v = _unit(np.frombuffer(b"".join(raws[s:e]), kind).reshape(e - s, -1))
            hit = (v @ v.T) >= least
            if crossing[s]:
                hit &= own[s:e, None] != own[None, s:e]
            i, j = np.nonzero(np.triu(hit, 1))
            if not len(i):
                continue
            i, j = i + s, j + s
            keep = np.concatenate([_here(near[i[c:c + 50_000]], near[j[c:c + 50_000]], int(key[s]), n, shared)
                                   for c in range(0, len(i), 50_000)])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            size = e - s
            links = (np.bincount(i - s, copies[j], minlength=size) + np.bincount(j - s, copies[i], minlength=size))
            has = np.flatnonzero(links)
            found_a.append(ids[s + has])
            found_b.append(ids[s + has])
            found_n.append(links[has].astype(np.int64))
            tree = np.array(Forest(size).join(i - s, j - s)).reshape(-1, 2)
            found_a.append(ids[s + tree[:, 0]])
            found_b.append(ids[s + tree[:, 1]])
            found_n.append(np.zeros(len(tree), np.int64))
        if found_a:
            yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b), "n": np.concatenate(found_n)})


def _here(a: np.ndarray, b: np.ndarray, key: int, n: int, shared: int) -> np.ndarray:
    """Pairs with enough shared pivots whose two smallest are those of this list."""
    p, q = divmod(key & ((1 << 40) - 1), n)
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    before = (both & (a < q) & (a != p)).any(axis=1)
    return (both.sum(axis=1) >= shared) & ~before


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shared: int = 2, vec_id: str = "vec_id",
                 embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links at `cosine` or more and the groups they make.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing, nor do
    vectors of different length. Rows with a null vec_id are left out; rows with one id count as one
    vector, the smallest. Equal vectors meet in a group first and are never paired. Lists of over BLOCK
    vectors are compared block by block, whole. Other columns, labels among them, are not read.
    """
    base = (vectors.where(F.col(vec_id).isNotNull())
            .groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.min(embedding).alias("embedding")))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    base = written(base.withColumn("usable", usable), "vectors")
    classes = base.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "vector-classes")
    distinct = classes.select(F.col("rep").alias("vec_id"), "copies", "embedding")
    total = distinct.count()
    n = max(MIN_PIVOTS, min(MAX_PIVOTS, math.ceil(math.sqrt(total))))
    points = pivots_for(distinct, n)
    held = vectors.sparkSession.sparkContext.broadcast(points)
    lists = distinct.mapInArrow(lambda it: _describe(it, held.value, n),
                                "key long, vec_id long, copies long, near binary, vector binary")
    lists = written(lists.select("vec_id", "copies", "near", "vector", "key"), "pivot-lists")
    kind = "<f4" if base.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    found = written(in_blocks(lists, "key", "vec_id", BLOCK, heavy=True)
                    .select("key", "lo", "hi", "own", "vec_id", "copies", "near", "vector")
                    .mapInPandas(lambda it: _verify(it, kind, n, cosine, shared), "a long, b long, n long"), "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    top = components(found.where("a <> b").select("a", "b"), "vector-trees")
    named = (classes.join(links, "rep", "left").join(top, F.col("rep") == F.col("node"), "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("component", "rep").alias("c")))
    return (base.join(named.withColumn("usable", F.lit(True)), ["usable", "embedding"], "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("c", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
