"""SimHash near-duplicate groups by pigeonring filtering.

A fingerprint is cut into M segments on a ring. If two fingerprints differ in at most `radius` bits,
some start on the ring has the property that the first l segments from there differ in at most
l * radius / M bits, for every l. The whole segments that this allows no difference form the join key
of that start; what meets under a key is pruned by the rest of the chain before the full check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Forest, components, in_blocks, whole_groups
from ..session import written

SEGMENTS = 8
RADIUS = 2
BLOCK = 1000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a whole text, 0 where it has no word."""
    return _fingerprint(text.encode("utf-8", "surrogatepass").lower().split() if text else [], words, seed)


def _fingerprint(tokens: list[bytes], words: int, seed: int) -> int:
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    elif words == 3:
        shingles = [b"%b %b %b" % t for t in zip(tokens, tokens[1:], tokens[2:], strict=False)]
    else:
        shingles = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):  # bounds the bit table of a very long text
        part = shingles[i:i + (1 << 16)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                 seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per row of `docs`, fp as a signed long.

    bytes.lower() folds A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D only, as asked for.
    """
    @F.pandas_udf(LongType())
    def fp(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(out.view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp"))


def _rotated(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bits turned so that the segment `start` comes first."""
    shift = (start.astype(np.uint64) * np.uint64(64 // SEGMENTS)) % np.uint64(64)
    back = (np.uint64(64) - shift) % np.uint64(64)
    return np.where(shift == 0, x, (x << shift) | (x >> back))


def chain_holds(diff: np.ndarray, start: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether cumulative differences from segment `start` on stay within l * radius / SEGMENTS."""
    turned = _rotated(diff, start)
    width = 64 // SEGMENTS
    good = np.ones(len(diff), bool)
    for length in range(1, SEGMENTS + 1):
        seen = np.bitwise_count(turned >> np.uint64(64 - width * length))
        good &= seen.astype(np.int64) * SEGMENTS <= length * radius
    return good


def key_segments(radius: int = RADIUS) -> int:
    """Segments at the head of a chain that may not differ at all."""
    return max(1, -(-SEGMENTS // radius) - 1) if radius else SEGMENTS


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_groups(frames, ["key", "lo", "hi"]):
        group = np.zeros(len(frame), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        fp = frame["fp"].to_numpy().view(np.uint64)
        rep, own, start = (frame[c].to_numpy() for c in ("rep", "own", "start"))
        crossing = frame["lo"].to_numpy() != frame["hi"].to_numpy()
        forest, found = Forest(len(frame)), []
        at = np.arange(len(frame) - 1)
        step = 1
        while len(at):
            at = at[at + step < len(frame)]
            at = at[group[at] == group[at + step]]
            i, j = at, at + step
            keep = ~crossing[i] | (own[i] != own[j])
            i, j = i[keep], j[keep]
            diff = fp[i] ^ fp[j]
            keep = chain_holds(diff, start[i])
            i, j, diff = i[keep], j[keep], diff[keep]
            keep = np.bitwise_count(diff) <= RADIUS
            found += forest.join(i[keep], j[keep])
            step += 1
        if found:
            i, j = np.array(found).T
            yield pd.DataFrame({"a": rep[i], "b": rep[j]})


def near_groups(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): groups of fingerprints linked at RADIUS or
    fewer differing bits, named by their smallest doc_id.

    Equal fingerprints meet in a group minimum first, so copies never form pairs. Each distinct one
    is stored under SEGMENTS keys; buckets are cut into bounded blocks, and a block returns only the
    links that connect it. Null fingerprints count as 0; rows with a null doc_id name no group and
    are left out; repeated rows are returned as often as they come.
    """
    prints = prints.where("doc_id is not null").select("doc_id", F.coalesce("fp", F.lit(0)).alias("fp"))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    width = 64 // SEGMENTS
    key_bits = width * key_segments()
    turned = lambda i: F.shiftleft("fp", width * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - width * i)) if i else F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("start"),
                              F.shiftrightunsigned(turned(i), 64 - key_bits).bitwiseOR(F.lit(i << 56)).alias("key"))
                     for i in range(SEGMENTS)])
    keyed = classes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.start", "k.key")
    edges = in_blocks(keyed, "key", "fp", BLOCK).select("key", "lo", "hi", "own", "start", "fp", "rep").mapInPandas(
        _links, "a long, b long")
    top = components(edges, "simhash-links")
    named = classes.join(top, classes["rep"] == top["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints and groups of whole texts; stored between the two, so texts are hashed once.

    A null or blank text has the fingerprint zero and links like any other. An empty table gives an
    empty result. Other columns of `docs` are not read, whatever their names.
    """
    return near_groups(written(fingerprints(docs, doc_id, text), "simhash-prints"))
