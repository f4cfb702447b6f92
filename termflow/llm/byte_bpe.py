"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: A text longer than this is cut before it is matched, where a border is safe.
PIECE = 1 << 16
#: No match joins a character that is not white space to white space after it, and none looks back,
#: so the start of white space after anything else is always the end of a match. (What is white space
#: to the rank pattern is so to \s here too; the other way round U+001C to U+001F are not.)
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
#: Runs this long are taken out of the pattern, whose white-space rule keeps a step for each character.
_LONG_BLANK = re.compile(r"[^\S\x1c-\x1f]{65536,}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut only at safe borders; a piece exceeds `size` where none comes sooner."""
    start = 0
    while len(text) - start > size:
        cut = _BORDER.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _encode_piece(enc: tiktoken.Encoding, text: str) -> list[int]:
    out: list[int] = []
    start = 0
    for run in _LONG_BLANK.finditer(text):
        # one match up to the last character, which belongs to what follows; at the end, the whole run
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[start:run.start()])
        out += enc._encode_single_piece(text[run.start():end])
        start = end
    return out + enc.encode_ordinary(text[start:])


def encode_text(enc: tiktoken.Encoding, text: str | None) -> bytes:
    if not text:
        return b""
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), "<u4").tobytes()
    return b"".join(np.array(_encode_piece(enc, p), "<u4").tobytes() for p in pieces(text))


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """Token ids of a whole text as little-endian unsigned 32-bit integers; null and empty texts
    have none. Special tokens do not exist: their names are ordinary text."""
    @F.pandas_udf(BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        enc = encoding(rank_file, pattern)
        return pd.Series([encode_text(enc, t) for t in texts], dtype=object)

    return run(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of token ids; they are the bytes of the text, also where an id holds only a
    part of a character. Null ids give no bytes; an id that the ranks do not hold is an error."""
    @F.pandas_udf(BinaryType())
    def run(column: pd.Series) -> pd.Series:
        enc = encoding(rank_file, pattern)
        return pd.Series([enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) if b else b"" for b in column],
                         dtype=object)

    return run(ids)
