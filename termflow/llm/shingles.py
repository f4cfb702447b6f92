"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Texts with equal shingle sets are one class. MinHash bands name classes that may be alike; what the bands
connect is compared in bounded blocks by the exact similarity, and links make the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import simhash
from .common import Forest, components, whole_groups
from .decontaminate import rolling

WORDS = 5
JACCARD = 0.8
#: A pair at 0.8 shares none of the bands with probability (1 - 0.8^ROWS)^BANDS, about 7e-7.
BANDS, ROWS = 60, 7
#: Classes and shingles of a block; blocks are compared two by two.
BLOCK, BLOCK_SHINGLES = 1000, 300_000
#: Texts of a block from which a shingle is counted in a matrix product.
DENSE = 16
_MULTIPLY, _ADD = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_MULTIPLY |= np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; a shorter text is one shingle, a blank one has none.

    Words are as for fingerprints: bytes.lower() and bytes.split().
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    h = rolling(hashes, min(words, len(tokens)))
    h ^= h >> np.uint64(31)
    h *= _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 256):  # stays in the cache
        part = found[i:i + 256, None] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS)


def sketched(docs: DataFrame, text: str, words: int) -> DataFrame:
    """Whole rows as `_doc`, so that no name can clash, with a number, the class (a 64-bit digest of the
    shingle set), its size and its band keys; stored, so that numbers stay."""
    @F.pandas_udf("class long, size long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = shingles(t, words)
            keys = bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64)
            out.append((np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64), len(found), keys))
        return pd.DataFrame(out, columns=["class", "size", "bands"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    return written(rows.withColumn("_s", sketch(F.col("_doc")[text]))
                   .select("*", F.col("_s.class").alias("_class"), F.col("_s.size").alias("_size"),
                           F.col("_s.bands").alias("_bands")).drop("_s"), "shingle-sketches")


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of all pairs with a Jaccard similarity of `least` or more."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    begins = _starts_of(every)
    holders = np.diff(np.append(begins, len(every)))
    both = np.zeros((n, n), np.int64)
    for d in range(2, min(DENSE, n + 1)):  # shingles that few texts hold: pair by pair
        rows, (x, y) = begins[holders == d], np.triu_indices(d, 1)
        step = (1 << 22) // len(x)
        for cut in range(0, len(rows), step):
            at = owner[rows[cut:cut + step, None] + np.arange(d)]
            both += np.bincount((at[:, x] * n + at[:, y]).ravel(), minlength=n * n).reshape(n, n)
    wide = np.flatnonzero(holders >= DENSE)
    for cut in range(0, len(wide), 2048):  # the others as products of 0/1 matrices
        part = wide[cut:cut + 2048]
        place = np.repeat(begins[part], holders[part]) + _counting(holders[part])
        m = np.zeros((n, len(part)), np.float32)
        m[owner[place], np.repeat(np.arange(len(part)), holders[part])] = 1
        both += (m @ m.T).astype(np.int64)
    i, j = np.nonzero(np.triu(both, 1))
    keep = both[i, j] >= least * (size[i] + size[j] - both[i, j])
    return i[keep], j[keep]


def _starts_of(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _counting(length: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for every length."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _links(frames: Iterator[pd.DataFrame], words: int, least: float) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_groups(frames, ["component", "lo", "hi"]):
        crossing = (frame["lo"] != frame["hi"]).to_numpy()
        own, name, texts = frame["own"].to_numpy(), frame["class"].to_numpy(), frame["text"].tolist()
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            if e - s == 1:
                continue
            i, j = alike([shingles(t, words) for t in texts[s:e]], least)
            if crossing[s]:
                keep = own[s + i] != own[s + j]
                i, j = i[keep], j[keep]
            tree = np.array(Forest(e - s).join(i, j), np.int64).reshape(-1, 2)
            if len(tree):
                yield pd.DataFrame({"a": name[s + tree[:, 0]], "b": name[s + tree[:, 1]]})


def fingerprint_links(base: DataFrame, text: str) -> DataFrame:
    """Classes (a, b) that the groups of fingerprints of op9 connect: each row's with that of the head of its group."""
    rows = base.select("_row", "_class", F.col("_doc")[text].alias("text"))
    groups = simhash.simhash_groups(rows, "_row", "text").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_head"))
    heads = base.select(F.col("_row").alias("_head"), F.col("_class").alias("b"))
    led = groups.where("_row <> _head").join(base.select("_row", F.col("_class").alias("a")), "_row")
    return led.join(heads, "_head").where("a <> b").select("a", "b").distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                least: float = JACCARD, fingerprints: bool = False) -> DataFrame:
    """One row of every group of texts linked at a Jaccard similarity of `least` or more: the one with the
    smallest id, null after all others; of rows with one id one stays.

    With `fingerprints`, texts whose fingerprints op9 links are linked too, so a group is what both connect.
    Texts without a word are one group. Other columns stay as they are, whatever their names.
    """
    base = sketched(docs, text, words)
    keyed = base.select(F.col("_class").alias("class"), F.explode("_bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("class").alias("m"), F.max("class").alias("n")).where("m <> n").drop("n")
    near = components(keyed.join(heads, "key").where("class <> m").select(F.col("class").alias("a"), F.col("m").alias("b")),
                      "shingle-candidates")
    first = base.groupBy(F.col("_class").alias("node")).agg(F.min("_row").alias("_row"), F.min("_size").alias("size"))
    members = written(near.join(first, "node"), "shingle-members")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("size") / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("_blocks"))
    cut = (members.join(sizes, "component")
           .withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_blocks")).cast("int"))
           .join(base.select("_row", F.col("_doc")[text].alias("text")), "_row")
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
           .select("component", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own",
                   F.col("node").alias("class"), "text"))
    links = (cut.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
             .mapInPandas(lambda it: _links(it, words, least), "a long, b long"))
    if fingerprints:
        links = fingerprint_links(base, text).union(links)
    top = components(links, "shingle-links").withColumnRenamed("component", "_top")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"))
    kept = (base.select("_row", "_class", F.col("_doc")[doc_id].alias("_id")).join(top, F.col("_class") == F.col("node"), "left")
            .groupBy(F.coalesce("_top", "_class").alias("g")).agg(F.min(order).alias("o")).select(F.col("o.r").alias("_row")))
    return base.join(kept, "_row", "left_semi").select("_doc.*")
