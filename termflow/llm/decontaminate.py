"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet where they share a seed, a run of `least` words (of all words of a shorter item). For each such pair
the longest common runs of words are marked as tiles, longest first and without overlap, found by
running Karp-Rabin hashes; the share of the item's words under tiles is its coverage. Reordered
passages keep their coverage, because tiles may stand in any order.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bytewords import words

LEAST = 5
COVERAGE = 0.5
FIRST_LENGTH = 20
#: Bytes of benchmark text that are held by a task at once; more are worked off block by block.
BLOCK_BYTES = 16 << 20
#: Characters of scripts that are written without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3031-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                      "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: What stands for marked tokens in comparisons; hashes of words are odd, so these equal nothing.
TAKEN_ITEM, TAKEN_DOC = np.uint64(2**64 - 2), np.uint64(2**64 - 4)
_BASE = 0xD6E8FEB86659FD93
_ROLL = np.uint64(_BASE)


def rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` tokens, modulo 2^64."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= _ROLL
        out += tokens[i:i + n]
    return out


def _free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of `length` without a mark."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[:-length]) if len(marked) >= length else np.zeros(0, np.int64)


def _matches(item, doc, free_item, free_doc, length: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked common runs of at least `length` tokens, as (size, place in item, in doc)."""
    ours, theirs = _free_runs(~free_item, length), _free_runs(~free_doc, length)
    if not len(ours) or not len(theirs):
        return []
    h_item, h_doc = rolling(item, length)[ours], rolling(doc, length)[theirs]
    order = np.argsort(h_doc, kind="stable")
    h_doc, theirs = h_doc[order], theirs[order]
    left, right = np.searchsorted(h_doc, h_item, "left"), np.searchsorted(h_doc, h_item, "right")
    padded = np.concatenate([np.where(free_doc, doc, TAKEN_DOC), np.full(len(item), TAKEN_DOC)])
    found = []
    for p, a, b in zip(ours.tolist(), left.tolist(), right.tolist(), strict=True):
        at = theirs[a:b]
        if p and free_item[p - 1]:  # part of the match that began one token before
            at = at[(at == 0) | (doc[at - 1] != item[p - 1]) | ~free_doc[at - 1]]
        width = len(item) - p
        ours_open = np.where(free_item[p:], item[p:], TAKEN_ITEM)
        for cut in range(0, len(at), max(1, (1 << 20) // width)):
            t = at[cut:cut + max(1, (1 << 20) // width)]
            same = (padded[t[:, None] + np.arange(width)] == ours_open)
            size = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            far = np.flatnonzero(size >= length)
            found += zip(size[far].tolist(), itertools.repeat(p), t[far].tolist())
    return found


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (size, place in item, place in doc) of each tile.

    Ties of size go to the first place in the item, then in the document.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        found = _matches(item, doc, free_item, free_doc, length)
        longest = max((m[0] for m in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        # A match may have lost tokens since; what is left of it waits its turn by its own size.
        heap = [(-size, p, t) for size, p, t in found]
        heapq.heapify(heap)
        while heap:
            size, p, t = heapq.heappop(heap)
            open_ = free_item[p:p - size] & free_doc[t:t - size]
            if open_.all():
                free_item[p:p - size] = False
                free_doc[t:t - size] = False
                out.append((-size, p, t))
            elif open_.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.view(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    if b - a >= length:
                        heapq.heappush(heap, (a - b, p + a, t + a))
            if not free_item.any():
                break
        if length == least:
            return out
        length = max(least, length // 2)


def _coverage(item: np.ndarray, doc: np.ndarray, shared: np.ndarray, least: int) -> tuple[int, int, int]:
    """Covered words of the item, tiles, longest tile. Only the stretches of the document under
    shared seeds can hold tiles, so the rest is cut out first."""
    at = np.flatnonzero(shared)
    under = np.zeros(len(doc) + 1, bool)
    for i in range(least):
        under[at + i] = True
    place = np.flatnonzero(under)
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    short = np.insert(doc[place], gap, np.uint64(0))  # a border that no item holds
    found = tiles(item, short, least)
    return sum(m[0] for m in found), len(found), max((m[0] for m in found), default=0)


def spaced(text: str | None) -> str | None:
    """The text with every character of scripts without blanks as a word."""
    return text if not text or text.isascii() else UNSPACED.sub(r" \g<0> ", text)


def item_tokens(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    parts = defaultdict(list)
    for w in words(spaced(t) for _, t in items):
        for n in np.unique(w.text):
            parts[int(n)].append(w.hash[w.text == n] | np.uint64(1))
    return [(items[n][0], np.concatenate(p)) for n, p in sorted(parts.items())]


class Seeds:
    """Index from the runs of `least` words to the items that hold them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int):
        self.items, self.least = items, least
        seeds = [rolling(t, least) for _, t in items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        # A seed that an item repeats points to it once: places are only asked for in the document.
        new = np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])]) if len(every) else np.zeros(0, bool)
        self.seeds, self.owner = every[new], owner[new]
        self.first = np.zeros(1 << 20, bool)  # a quick no for most runs
        self.first[(every >> np.uint64(44)).astype(np.int64)] = True

    def search(self, token: np.ndarray, text: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """As Benchmark.search, for the words of n texts and the number of the text of each."""
        runs = rolling(token, self.least)
        hit = np.flatnonzero(self.first[(runs >> np.uint64(44)).astype(np.int64)])
        hit = hit[text[hit] == text[hit + self.least - 1]]
        left = np.searchsorted(self.seeds, runs[hit], "left")
        count = np.searchsorted(self.seeds, runs[hit], "right") - left
        hit, left, count = hit[count > 0], left[count > 0], count[count > 0]
        if not len(hit):
            return
        borders = np.searchsorted(text, np.arange(n + 1))
        where = np.repeat(hit, count)
        item = self.owner[np.repeat(left, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        pair = text[where] * len(self.items) + item
        order = np.argsort(pair, kind="stable")
        pair, where = pair[order], where[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)], strict=True):
            number, k = divmod(int(pair[a]), len(self.items))
            lo, hi = borders[number], borders[number + 1]
            shared = np.zeros(hi - lo, bool)
            shared[where[a:b] - lo] = True
            item_id, tokens = self.items[k]
            yield (number, item_id, len(tokens), *_coverage(tokens, token[lo:hi], shared, self.least))


class Benchmark:
    """Items of one block with an index from seeds to items. An item of fewer than `least` words is its own seed."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        by_length = defaultdict(list)
        for item in item_tokens(items):
            by_length[min(least, len(item[1]))].append(item)
        self.seeds = [Seeds(part, length) for length, part in sorted(by_length.items())]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item_id, words of the item, covered words, tiles, longest tile)."""
        if not self.seeds:
            return
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w in words(map(spaced, texts)):
            hashes.append(w.hash | np.uint64(1))
            owners.append(w.text)
        token, text = np.concatenate(hashes), np.concatenate(owners)
        for seeds in self.seeds:
            yield from seeds.search(token, text, len(texts))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", least: int = LEAST,
                 coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, longest_tile, coverage) of every document row
    and benchmark item whose coverage reaches the threshold.

    Words are runs of letters and digits in lower case, and the single characters of scripts written without
    blanks. An item of fewer than `least` words is found where all of it stands in one run. Null or empty
    texts, documents without a shared seed and items without a word give no row; repeated rows of either table give repeated
    or equal rows; an empty table gives an empty result. Other columns are not read.
    The documents are not moved. The benchmark is read in blocks of about BLOCK_BYTES, chosen by a hash
    of the item, so what a task holds of it is bounded however large it is.
    """
    items = (benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
             .select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).distinct())
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, item_id long, item_words long, covered_words long, tiles long, "
              "longest_tile long, coverage double")
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block)
        held = docs.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.item_text) for r in part.collect()))

        def search(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = Benchmark(held.value, least)
            for frame in frames:
                found = list(index.search(frame["text"].tolist()))
                ids = frame["doc_id"].to_numpy()
                rows = [(ids[n], *rest, rest[2] / rest[1]) for n, *rest in found if rest[2] >= coverage * rest[1]]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "covered_words", "tiles",
                                                      "longest_tile", "coverage"])

        rows = narrow.mapInPandas(search, schema)
        if blocks > 1:  # worked off block by block, so that one is held at a time
            rows = written(rows, "leaks")
            held.unpersist()
        out = rows if out is None else out.unionByName(rows)
    return out
