"""Language of the words of a text by a linear-chain conditional random field.

Each word is a step of the chain. Its features are hashed character n-grams, affixes (n-grams that
touch the word's border) and the whole word (lexicon); weights of features and of transitions between
languages are learned together on code-switched sequences, and forward-backward gives the probability
of every language for every word. The mean over the words labels the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SLICE, Words, words

ORDERS = (2, 3, 4)
BITS = 17
#: Bounds of the labelled sample: documents per language, and words of each document, taken as SPANS
#: spans spread evenly over the whole text.
SAMPLE_ROWS = 400
SPANS, SPAN_WORDS = 16, 16
#: Languages up to which messages are passed by step matrices, and up to which each is sampled by a limit of its own.
FEW, APART = 8, 64
UNKNOWN = "und"
#: Words of one chain; a longer text is labelled as several chains.
CHAIN = 1 << 16
STEP = 32


@dataclass
class Crf:
    """Languages, feature weights [feature, language], start and transition scores."""

    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    transition: np.ndarray


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of every n-gram inside the words, with their borders, and of every whole word."""
    size = w.end - w.start + 2
    first = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(first, size)
    at = inside + np.repeat(w.start - 1, size)
    left = np.repeat(size, size) - inside  # bytes from here to the closing border
    word = np.repeat(np.arange(len(size)), size)
    feature, owner = [], []
    data = w.data.astype(np.uint32)
    rolled = data[at]
    for n in range(2, max(ORDERS) + 1):
        keep = left >= n
        at, left, word, rolled = at[keep], left[keep], word[keep], rolled[keep]
        rolled = rolled * np.uint32(0x01000193) + data[at + n - 1]
        if n in ORDERS:
            mixed = (rolled * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            feature.append((mixed >> np.uint32(32 - BITS)).astype(np.int32))
            owner.append(word)
    feature.append(((w.hash >> np.uint64(64 - BITS)) ^ np.uint64(0x5555)).astype(np.int32))
    owner.append(np.arange(len(size)))
    return np.concatenate(feature), np.concatenate(owner)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Score of every language for every word: the mean weight of its n-grams plus its lexicon weight."""
    feature, owner = features(w)
    n = len(w.start)
    share = _shares(owner, n)
    return np.stack([np.bincount(owner, weights[feature, k] * share, minlength=n) for k in range(weights.shape[1])],
                    axis=1)


def _shares(owner: np.ndarray, n: int) -> np.ndarray:
    """1 over the n-grams of its word for an n-gram, 1 for the whole word (the last n entries)."""
    grams = np.bincount(owner[:-n] if n else owner, minlength=n)
    out = np.ones(len(owner), np.float32)
    if n:
        out[:-n] = 1 / np.sqrt(grams[owner[:-n]])
    return out


def marginals(scores: np.ndarray, chain: np.ndarray, crf: Crf) -> np.ndarray:
    """Forward-backward over many chains at once: probability of each language for each word.

    `chain` numbers the chain of each word and does not decrease. Chains are cut into steps of STEP
    words; products of the step matrices carry the forward and backward messages from step to step,
    and all steps are then filled in side by side.
    """
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k))
    if k > FEW:  # a matrix for every word would not fit
        return by_word(scores, chain, crf)
    begins = np.flatnonzero(np.diff(chain, prepend=-1))
    length = np.diff(np.append(begins, len(chain)))
    steps = -(-length // STEP)
    first_step = np.cumsum(steps) - steps
    place = np.arange(len(chain)) - np.repeat(begins, length)
    row, col = np.repeat(first_step, length) + place // STEP, place % STEP
    move = np.exp(crf.transition - crf.transition.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    m = np.empty((steps.sum(), STEP, k, k))
    m[:] = np.eye(k)
    m[row, col] = move[None] * emit[:, None, :]
    m[first_step, 0] = (np.exp(crf.start - crf.start.max()) * emit[begins])[:, None, :]
    whole = m[:, 0]
    for s in range(1, STEP):
        whole = whole @ m[:, s]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((len(m), k)), np.empty((len(m), k))
    order = np.argsort(-steps, kind="stable")
    alive = np.searchsorted(-steps[order], -np.arange(steps.max()), "left")  # chains with more than t steps
    message = np.full((len(steps), k), 1 / k)
    for t in range(steps.max()):
        at = first_step[order[:alive[t]]] + t
        ahead[at] = message[:alive[t]]
        new = np.einsum("ci,cij->cj", message[:alive[t]], whole[at])
        message[:alive[t]] = new / new.sum(axis=1, keepdims=True)
    message = np.full((len(steps), k), 1 / k)
    for t in range(steps.max() - 1, -1, -1):
        at = first_step[order[:alive[t]]] + t
        behind[at] = message[:alive[t]]
        new = np.einsum("cij,cj->ci", whole[at], message[:alive[t]])
        message[:alive[t]] = new / new.sum(axis=1, keepdims=True)
    forward = np.empty((len(m), STEP, k))
    for s in range(STEP):
        ahead = np.einsum("ci,cij->cj", ahead, m[:, s])
        ahead /= ahead.sum(axis=1, keepdims=True)
        forward[:, s] = ahead
    for s in range(STEP - 1, -1, -1):
        forward[:, s] *= behind
        behind = np.einsum("cij,cj->ci", m[:, s], behind)
        behind /= behind.sum(axis=1, keepdims=True)
    out = forward[row, col]
    return out / out.sum(axis=1, keepdims=True)


def by_word(scores: np.ndarray, chain: np.ndarray, crf: Crf) -> np.ndarray:
    """The same probabilities word by word; memory grows with the languages, not with their square."""
    move = np.exp(crf.transition - crf.transition.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    out, behind = _filtered(emit, chain, crf, move), np.ones_like(emit)
    begins = np.flatnonzero(np.diff(chain, prepend=-1))
    length = np.diff(np.append(begins, len(chain)))
    begins, length = begins[np.argsort(-length)], -np.sort(-length)
    for t in range(length[0] - 2, -1, -1):
        at = begins[:np.searchsorted(-length, -t - 1, "left")] + t
        behind[at] = (behind[at + 1] * emit[at + 1]) @ move.T
        behind[at] /= behind[at].sum(axis=1, keepdims=True)
    out *= behind
    return out / out.sum(axis=1, keepdims=True)


def _spans(text: str) -> list[str]:
    """Up to SPANS runs of SPAN_WORDS words, spread evenly over the text."""
    every = text.split()
    runs = [every[i:i + SPAN_WORDS] for i in range(0, len(every), SPAN_WORDS)]
    if len(runs) > SPANS:
        runs = [runs[i * len(runs) // SPANS] for i in range(SPANS)]
    return [" ".join(r) for r in runs]


def fit(docs: DataFrame, usable: Column, rows: int = SAMPLE_ROWS, epochs: int = 3, seed: int = 5) -> Crf:
    """Fit on at most `rows` documents of each lang among the rows for which `usable` holds; of rows with
    one id and lang, the spans that come first.

    Every language is learned; the driver holds 2 MB of weights and gradients for each. Spans of the sample are strung together in random order, so chains switch languages as texts do;
    weights, start and transitions follow the gradient of the conditional likelihood.
    """
    known = docs.where(usable).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = known.select("lang", F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id").distinct()
    top = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if not top:
        return Crf([], np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros((0, 0)))
    picks = None
    if len(top) > APART:
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
        picks = ids.withColumn("_n", place).where(F.col("_n") <= rows).drop("_n")
    for lang in top if picks is None else ():
        one = ids.where(F.col("lang") == lang).orderBy("h", "doc_id").limit(rows)
        picks = one if picks is None else picks.union(one)

    @F.pandas_udf("array<string>")
    def spans(column: pd.Series) -> pd.Series:
        return column.map(_spans)

    sample = (known.join(F.broadcast(picks.select("lang", "doc_id").distinct()), ["lang", "doc_id"])
              .select("lang", "doc_id", spans("text").alias("spans"))
              .groupBy("lang", "doc_id").agg(F.min("spans").alias("spans")).orderBy("doc_id", "lang").toPandas())
    languages = top
    label = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    texts = [(s, label[lang]) for lang, ss in zip(sample["lang"], sample["spans"], strict=True) for s in ss]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    k = len(languages)
    weights, start, move = np.zeros((1 << BITS, k)), np.zeros(k), np.zeros((k, k))
    square, square_move, square_start = np.full((1 << BITS, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    crf = Crf(languages, weights, start, move)
    batch, run = 256, 4  # spans of a step, spans of a chain
    for _ in range(epochs):
        for at in range(0, len(texts), batch):
            part = texts[at:at + batch]
            for w in words((s for s, _ in part), digits=False):
                if not len(w.start):
                    continue
                y = np.array([c for _, c in part])[w.text]
                feature, owner = features(w)
                share = _shares(owner, len(y))
                scores = np.stack([np.bincount(owner, weights[feature, j] * share, minlength=len(y)) for j in range(k)], 1)
                chain = w.text // run
                p = marginals(scores, chain, crf)
                gap = p - np.eye(k)[y]
                # expected moves under the chain are close to the product of neighbouring marginals
                next_ = np.flatnonzero(chain[1:] == chain[:-1])
                g_move = (_moves(scores, chain, crf, p, next_) - _counted(y[next_], y[next_ + 1], k)) / len(y)
                begins = np.flatnonzero(np.diff(chain, prepend=-1))
                g_start = gap[begins].mean(axis=0)
                used, inverse = np.unique(feature, return_inverse=True)
                g = np.stack([np.bincount(inverse, gap[owner, j] * share, minlength=len(used)) for j in range(k)], 1)
                g = g / len(y) * 50 + 1e-5 * weights[used]
                square[used] += g * g
                weights[used] -= 0.3 * g / np.sqrt(square[used])
                square_move += g_move * g_move
                move -= 0.1 * g_move / np.sqrt(square_move)
                square_start += g_start * g_start
                start -= 0.1 * g_start / np.sqrt(square_start)
    return Crf(languages, weights.astype(np.float32), start, move)


def _counted(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(a * k + b, minlength=k * k).reshape(k, k).astype(float)


def _moves(scores, chain, crf: Crf, p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected transitions: forward message, move, emission and backward message of each pair."""
    move = np.exp(crf.transition - crf.transition.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    forward = _filtered(emit, chain, crf, move)
    predicted = forward @ move
    # p(j) / predicted(j) carries emission and backward message of the later word
    return move * (forward[at].T @ (p[at + 1] / np.maximum(predicted[at], 1e-300)))


def _filtered(emit, chain, crf: Crf, move) -> np.ndarray:
    """Forward probabilities, all chains side by side."""
    begins = np.flatnonzero(np.diff(chain, prepend=-1))
    length = np.diff(np.append(begins, len(chain)))
    out = np.empty_like(emit)
    out[begins] = np.exp(crf.start - crf.start.max()) * emit[begins]
    out[begins] /= out[begins].sum(axis=1, keepdims=True)
    for t in range(1, length.max()):
        at = begins[length > t] + t
        out[at] = (out[at - 1] @ move) * emit[at]
        out[at] /= out[at].sum(axis=1, keepdims=True)
    return out


def label_texts(texts: list[str | None], crf: Crf) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts: the language with the highest mean word probability."""
    k = len(crf.languages)
    total, count = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    if k:
        for w in words(texts, digits=False, size=max(1 << 14, SLICE // 2 * FEW // max(FEW, k))):
            if not len(w.start):
                continue
            place = np.arange(len(w.text)) - np.searchsorted(w.text, w.text, "left")
            chain = np.cumsum(np.diff(w.text, prepend=-1) + (place % CHAIN == 0) > 0) - 1
            p = marginals(emissions(w, crf.weights), chain, crf)
            for j in range(k):
                total[:, j] += np.bincount(w.text, p[:, j], minlength=len(texts))
            count += np.bincount(w.text, minlength=len(texts))
    names, scores = [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text or not k or not count[i] or not any(map(str.isalpha, text)):
            names.append(UNKNOWN)
            continue
        best = int(np.argmax(total[i]))
        names.append(crf.languages[best])
        scores[i] = min(1.0, total[i, best] / count[i])
    return names, scores


def predict(text: Column, crf: Crf, spark) -> Column:
    """struct(lang_pred, score) from the whole text alone. Texts that are null, empty or without a
    letter are `und` with score 0, and so is everything if nothing was learned; ties of languages go
    to the first by name. A text of over CHAIN words is labelled chain by chain, all words counting."""
    held = spark.sparkContext.broadcast(crf)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = label_texts(texts.tolist(), held.value)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def words_of(text: str, crf: Crf) -> Iterator[tuple[str, str, float]]:
    """(word, language, probability) of each word of one code-switched text, as a check by eye."""
    for w in words([text], digits=False):
        p = marginals(emissions(w, crf.weights), np.zeros(len(w.start), np.int64), crf)
        for s, e, row in zip(w.start, w.end, p, strict=True):
            yield w.data[s:e].tobytes().decode("utf-8", "replace"), crf.languages[int(row.argmax())], float(row.max())
