"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

ORDERS = (3, 4, 5, 6)
BITS = 21
#: Bound of the labelled sample that the model is fitted on, in rows.
SAMPLE_ROWS = 20_000
#: Features kept for the linear model, those that say most about the label.
FEATURES = 8_000
#: Chi-square of label and n-gram from which a feature may be kept: a few chance meetings in a small
#: sample do not reach it.
SURE = 15.0
THRESHOLD = 0.7
SMOOTHING = 0.5
#: Characters handled at once.
SLICE = 1 << 18


def grams(texts: list[str | None], table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, feature) of the n-grams of all whole texts, in slices. A feature that
    occurs again in the same slice comes once; `table`, if given, holds a true value for each feature
    wanted. n-grams are taken over characters in lower case, with white space as one kind of blank."""
    parts: list[np.ndarray] = []
    owner: list[int] = []
    size = 0
    reach = max(ORDERS) - 1
    for number, text in enumerate(texts):
        data = np.frombuffer(f" {text.lower().translate(_BLANKS)} ".encode("utf-32-le", "replace"), "<u4") if text else ()
        for at in range(0, len(data), SLICE - reach):  # a long text goes on, with an overlap
            if at and len(data) - at <= reach:
                break
            piece = data[at:at + SLICE]
            parts += [piece, np.zeros(reach, "<u4")]
            owner.append(number)
            size += len(piece) + reach
            if size >= SLICE:
                yield _grams(parts, owner, table)
                parts, owner, size = [], [], 0
    if parts:
        yield _grams(parts, owner, table)


_BLANKS = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def _grams(parts: list[np.ndarray], owner: list[int], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.concatenate(parts)
    ends = np.cumsum([len(a) + len(b) for a, b in zip(parts[::2], parts[1::2], strict=True)])
    rolled = data + np.uint32(1)
    found = []
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + data[n - 1:]
        if n not in ORDERS:
            continue
        feature = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        keep = data[n - 1:] != 0
        if table is not None:
            keep &= table[feature]
        at = np.flatnonzero(keep)
        at = at[data[at] != 0]
        found.append(np.searchsorted(ends, at, "right").astype(np.int64) << BITS | feature[at])
    both = np.unique(np.concatenate(found))
    return np.asarray(owner)[both >> BITS], both & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weights over feature numbers (log-count ratio times learned weight) and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[self.features] = True
        weight[self.features] = self.weights
        return wanted, weight


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """At most `rows` labelled documents, chosen by a hash of their id among all that may be used; of rows
    with one id, the smallest text."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(usable)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    chosen = ids.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    once = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"))
    return written(once, "labelled-sample")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for frame in frames:
        y = frame["y"].to_numpy()
        for number, feature in _distinct(frame["text"].tolist(), None):
            for label in (0, 1):
                counts[label] += np.bincount(feature[y[number] == label], minlength=1 << BITS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"feature": used, "clean": counts[0, used], "toxic": counts[1, used]})


def _distinct(texts: list[str | None], table: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As grams(), with each (text, feature) once also where a text goes on over several slices."""
    held = None
    for number, feature in grams(texts, table):
        key = number.astype(np.int64) << BITS | feature
        key = key if held is None else np.union1d(held, key)
        if not len(key):
            held = None
            continue
        last = key[-1] >> BITS
        cut = np.searchsorted(key, last << BITS)
        held, done = key[cut:], key[:cut]
        if len(done):
            yield done >> BITS, done & ((1 << BITS) - 1)
    if held is not None and len(held):
        yield held >> BITS, held & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` documents of `labels` (doc_id, toxic) for which `usable` holds.

    Document frequencies of all hashed n-grams of the sample are counted by Spark; the log-count
    ratios that say most are kept, and a logistic regression on features scaled by them is solved on
    the driver, over bounded arrays. A document with several labels is toxic if one says so. Without
    documents of both classes every score is the smoothed share of toxic documents.
    """
    sample = _sample(docs, labels, usable, rows)
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((toxic + 0.5) / (clean + 0.5)))
    empty = np.zeros(0, np.int64)
    if not clean or not toxic:
        return Model(empty, np.zeros(0), prior)
    p = (F.col("toxic") + SMOOTHING) / (toxic + 2 * SMOOTHING)
    q = (F.col("clean") + SMOOTHING) / (clean + 2 * SMOOTHING)
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    gap = F.col("toxic") / toxic - F.col("clean") / clean
    sure = gap * gap >= SURE * share * (1 - share) * (1 / toxic + 1 / clean)
    ratios = (sample.mapInPandas(_count, "feature long, clean long, toxic long")
              .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
              .where(sure).withColumn("ratio", F.log(p / q))
              .withColumn("gain", F.abs("ratio") * F.sqrt(F.col("clean") + F.col("toxic")))
              .orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature", "ratio").toPandas())
    features, ratio = ratios["feature"].to_numpy(), ratios["ratio"].to_numpy()
    number = np.full(1 << BITS, -1, np.int32)
    number[features] = np.arange(len(features))
    known = docs.sparkSession.sparkContext.broadcast(number)

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [b""] * len(frame)
            for text, feature in _distinct(frame["text"].tolist(), known.value >= 0):
                edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    out[text[a]] = known.value[feature[a:b]].astype("<u2").tobytes()
            yield pd.DataFrame({"y": frame["y"], "x": out})

    data = sample.mapInPandas(rows_of, "y int, x binary").toPandas()
    known.unpersist()
    lengths = data["x"].map(len).to_numpy() // 2
    column = np.frombuffer(b"".join(data["x"]), "<u2")
    y = data["y"].to_numpy(float)
    del data
    weights, intercept = _logistic(column, lengths, y, ratio, prior)
    return Model(features, weights * ratio, intercept)


def _logistic(column: np.ndarray, lengths: np.ndarray, y: np.ndarray, scale: np.ndarray, start: float,
              rounds: int = 200, rate: float = 0.05, penalty: float = 1e-4, part: int = 1000) -> tuple[np.ndarray, float]:
    """Logistic regression on present features scaled by `scale`, by Adam on the whole sample.

    `column` holds the features of all rows end to end; they are worked off `part` rows at a time."""
    ends = np.cumsum(lengths)
    blocks = [(i, min(i + part, len(y))) for i in range(0, len(y), part)]
    w, b = np.zeros(len(scale)), start
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, rounds + 1):
        g = np.zeros(len(scale) + 1)
        weight = w * scale
        for lo, hi in blocks:
            features = column[ends[lo] - lengths[lo]:ends[hi - 1]]
            row = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            gap = _sigmoid(np.bincount(row, weight[features], minlength=hi - lo) + b) - y[lo:hi]
            g[:-1] += np.bincount(features, gap[row], minlength=len(w))
            g[-1] += gap.sum()
        g[:-1] *= scale
        g /= len(y)
        g[:-1] += penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(text: Column, model: Model, spark) -> Column:
    """Probability of the toxic class from the whole text alone. Null and empty texts have no
    feature, so they get the intercept."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        wanted, weight = held.value.tables()
        z = np.full(len(texts), held.value.intercept)
        for number, feature in _distinct(texts.tolist(), wanted):
            z += np.bincount(number, weight[feature], minlength=len(texts))
        return pd.Series(_sigmoid(z))

    return run(text)
