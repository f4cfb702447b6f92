"""Token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream whose record batches hold fixed-size lists: `ids` and a `mask` that is
false on padding. All batches of a file but the last have the same number of sequences, so all have the
same size in bytes, and the place of a sequence in the file follows from its number: a reader maps the
file and looks at any sequence without a copy and without reading what stands before it. A second stream
beside it holds the documents: id, first token in the file, number of tokens.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path, written

SEQUENCE = 1024
BATCH_SEQUENCES = 256
#: Bytes of text that go into one file, about.
FILE_BYTES = 32 << 20
#: Entries of a task's word cache; it starts anew beyond.
CACHE = 400_000
#: Latin letters whose lower case is one letter (that of U+0130 ends in a mark), then marks but the apostrophe.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


class WordCache(dict):
    """Ids of words by their text, as bytes. The tokenizer drops white space and joins nothing over it,
    so a text is encoded word by word; marks after a plain word are words of their own. Special tokens
    in a text get their own ids, as in the library; they hold no white space."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain: dict[str, bytes] = {}
        super().__init__({"": b""})

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, word: str) -> bytes:
        ids = self.plain.get(word)
        if ids is None:
            ids = self.plain[word] = self._encode(word)
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self._encode(word)
        parts = _WORD.fullmatch(word)
        if parts:
            ids = self._plain(parts[1].lower()) + (self._plain(parts[2]) if parts[2] else b"")
        else:
            ids = self._encode(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if len(self) > CACHE:
            self.clear()
            self[""] = b""
        if len(self.plain) > CACHE:
            self.plain.clear()
        return b"".join([self[w] for w in text.replace("\n", " ").split(" ")]) if text else b""


@lru_cache(maxsize=2)
def cache_for(tokenizer_file: str) -> WordCache:
    return WordCache(tokenizer_file)


def sequence_schema(kind: np.dtype, length: int = SEQUENCE) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(kind), length), False),
                      pa.field("mask", pa.list_(pa.bool_(), length), False)])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """Writes one file and the stream of its documents; holds one batch of sequences at most."""

    def __init__(self, path: str, kind: np.dtype, length: int = SEQUENCE, batch: int = BATCH_SEQUENCES):
        store, inner = fs.FileSystem.from_uri(path)
        self.kind, self.length, self.batch = kind, length, batch
        self.schema = sequence_schema(kind, length)
        self.files = [store.open_output_stream(inner), store.open_output_stream(inner + ".docs")]
        self.stream = pa.ipc.new_stream(self.files[0], self.schema)
        self.docs = pa.ipc.new_stream(self.files[1], DOCUMENTS)
        self.held: list[bytes] = []
        self.size = self.tokens = self.documents = 0

    def add(self, ids: list[bytes], doc_ids: list) -> None:
        counts = np.array([len(b) // self.kind.itemsize for b in ids], np.int64)
        starts = self.tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)],
                                              schema=DOCUMENTS))
        self.tokens += int(counts.sum())
        self.documents += len(ids)
        for b in ids:
            self.held.append(b)
            self.size += len(b)
            if self.size >= self._full():
                self._flush(False)

    def _full(self) -> int:
        return self.batch * self.length * self.kind.itemsize

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        at = 0
        while len(data) - at >= self._full():
            self._write(np.frombuffer(data, self.kind, self.batch * self.length, at), self.batch * self.length)
            at += self._full()
        rest = np.frombuffer(data, self.kind, offset=at) if at < len(data) else np.zeros(0, self.kind)
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.kind)
            padded[:len(rest)] = rest
            self._write(padded, len(rest))
            rest = rest[:0]
        self.held, self.size = [rest.tobytes()], rest.nbytes

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.stream.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
             pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for w in (self.stream, self.docs, *self.files):
            w.close()


class Reader:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)
        self.schema = pa.ipc.read_schema(self.source)
        self.head = self.source.tell()
        self.size = self.source.size()
        self.length = self.schema.field("ids").type.list_size
        self.kind = np.dtype(self.schema.field("ids").type.value_type.to_pandas_dtype())
        first = self._at(self.head)
        self.step = self.source.tell() - self.head
        self.batch = len(first) if first is not None else 0

    def _at(self, place: int):
        self.source.seek(place)
        try:
            message = pa.ipc.read_message(self.source)
        except EOFError:
            return None
        return pa.ipc.read_record_batch(message, self.schema)

    def record_batch(self, i: int) -> pa.RecordBatch:
        out = self._at(self.head + i * self.step)
        if out is None:
            raise IndexError(i)
        return out

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of one sequence."""
        batch = self.record_batch(number // self.batch)
        at = number % self.batch
        ids, mask = (batch.column(c).flatten() for c in (0, 1))
        return (ids.to_numpy()[at * self.length:(at + 1) * self.length],
                mask.slice(at * self.length, self.length).to_numpy(zero_copy_only=False))

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids [start, start + count), as views of one batch after the other."""
        width = self.batch * self.length
        while count > 0:
            i, at = divmod(start, width)
            if getattr(self, "_number", None) != i:
                self._number, self._ids = i, self.record_batch(i).column(0).flatten().to_numpy()
            part = self._ids[at:at + count]
            yield part
            start, count = start + len(part), count - len(part)


def documents_of(path: str) -> Iterator[pa.RecordBatch]:
    store, inner = fs.FileSystem.from_uri(path + ".docs")
    with store.open_input_stream(inner) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                 length: int = SEQUENCE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns one row per file:
    (path, number, documents, tokens, base), base being the tokens of all files before it.

    Each document is followed by end_id; a null or empty text is the end_id alone. Null ids come first,
    rows with one id in the order of a hash of their text. Texts are dealt out by ranges of the id, so a
    file holds one range; a task writes its file under a name of its own and reports it only when it is
    complete, so a task that is run again leaves no half file behind that anyone reads.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = new_path(spark, "tokens")
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner)
    ordered = (narrow.withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words = cache_for(tokenizer_file)
        end = np.array([end_id], words.kind).tobytes()
        path = f"{folder}/{uuid.uuid4().hex}.arrows"
        out = None
        for batch in batches:
            if not len(batch):
                continue
            out = out or Writer(path, words.kind, length)
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                out.add([words.encode(t) + end for t in texts.slice(at, 256).to_pylist()], ids[at:at + 256])
        if out:
            out.close()
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"path": path, "number": number, "documents": out.documents,
                                               "tokens": out.tokens}], _FILES)

    files = written(ordered.mapInArrow(write, "path string, number long, documents long, tokens long"), "token-files")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


_FILES = pa.schema([("path", pa.string()), ("number", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])


def read_digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                reader = Reader(path)
                for batch in documents_of(path):
                    start, count = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                    crc = np.zeros(len(batch), np.int64)
                    for i, (s, n) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
                        value = 0
                        for part in reader.tokens(s, n):
                            value = zlib.crc32(part.astype("<u4").data, value)
                        crc[i] = value
                    yield pd.DataFrame({"doc_id": batch.column(0).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                                        "start": start + base, "n_tokens": count, "ids_crc32": crc})

    one_each = files.repartitionByRange(max(1, files.count()), "number")  # as many tasks as files
    return one_each.select("path", "base").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
