"""Words of many texts at once, as positions in one byte array."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Bytes handled at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_OTHER_MARKS = re.compile(r"[^\w\s\x00-\x7f]")


@lru_cache(maxsize=4)
def _letters(digits: bool) -> np.ndarray:
    """Which bytes belong to words: ASCII letters, parts of other characters, digits on demand."""
    out = np.zeros(256, bool)
    out[ord("a"):ord("z") + 1] = True
    out[ord("A"):ord("Z") + 1] = True
    out[0x80:] = True
    if digits:
        out[ord("0"):ord("9") + 1] = True
    return out


@lru_cache(maxsize=1)
def _powers(n: int = SLICE + 64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    done = 1
    while done < n:  # doubles the known part
        more = min(done, n - done)
        up[done:done + more] = up[:more] * np.uint64(pow(_BASE, done, 1 << 64))
        down[done:done + more] = down[:more] * np.uint64(pow(inverse, done, 1 << 64))
        done += more
    return up, down


@dataclass
class Words:
    """Words of a slice: the bytes with a blank for everything else, [start, end) of each word, the
    number of its text, and a 64-bit hash of its bytes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def cleaned(text: str) -> bytes:
    """Lower case, with blanks for marks outside ASCII, as UTF-8."""
    text = text.lower()
    if not text.isascii():
        text = _OTHER_MARKS.sub(" ", text)
    return text.encode("utf-8", "replace")


def words(texts: Iterable[str | None], digits: bool = True, size: int | None = None) -> Iterator[Words]:
    """Slices of about `size` (SLICE) bytes with the words of all texts in order. A text that fits in a slice is
    never cut; a longer one begins a slice and goes on in the next ones, cut at a blank, so where a text is
    cut depends on nothing but the text. Only a word of over `size` bytes is cut inside."""
    limit = size or SLICE
    held: list[bytes] = []
    numbers: list[int] = []
    held_size = 0
    for number, text in enumerate(texts):
        data = cleaned(text) if text else b""
        if held and held_size + len(data) > limit:
            yield _slice(held, numbers, digits)
            held, numbers, held_size = [], [], 0
        at = 0
        while len(data) - at > limit:
            cut = max(data.rfind(b" ", at, at + limit), data.rfind(b"\n", at, at + limit))
            cut = cut if cut > at else at + limit
            yield _slice([data[at:cut]], [number], digits)
            at = cut
        if at < len(data):
            held.append(data[at:])
            numbers.append(number)
            held_size += len(data) - at + 1
    if held:
        yield _slice(held, numbers, digits)


def _slice(parts: list[bytes], numbers: list[int], digits: bool) -> Words:
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    inside = _letters(digits)[raw]
    data = np.where(inside, raw, np.uint8(32))
    step = np.diff(inside.view(np.int8))
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    offsets = np.cumsum([1, *[len(p) + 1 for p in parts[:-1]]])
    text = np.asarray(numbers)[np.searchsorted(offsets, start, "right") - 1]
    if len(data) > len(_powers()[0]):
        _powers.cache_clear()
        up, down = _powers(len(data))
    else:
        up, down = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return Words(data, start, end, text, h ^ (h >> np.uint64(29)))
