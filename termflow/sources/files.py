"""Finding input files, checking them and choosing a reader."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import new_path, written

#: Bytes of contents that a task holds at once, besides the last file that it opened.
HELD_BYTES = 8 << 20


def reader_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in K.READER_BY_EXTENSION.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), T.file_extension(path)), F.lit(""))


def check_files(files: DataFrame, max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Add `reader` and `verdict` to files(path, length)."""
    reader = reader_of(F.col("path"))
    return files.withColumn("reader", reader).withColumn(
        "verdict", F.when(reader == "", "unsupported").when(F.col("length") > max_bytes, "too_large").otherwise("ok"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files under a folder, empty ones too. Tasks list folders, one level after another, so the
    driver holds no file. Names that begin with a dot or an underscore are left out, as Spark does."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for own in (own for batch in batches for own in batch.column(0).to_pylist()):
            found = [x for x in store.get_file_info(fs.FileSelector(root + own)) if not x.base_name.startswith((".", "_"))]
            for at in range(0, len(found), 10_000):
                part = found[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{own}/{x.base_name}" for x in part], pa.string()), pa.array([x.size for x in part], pa.int64()),
                    pa.array([x.type == fs.FileType.Directory for x in part], pa.bool_())], ["own", "length", "is_folder"])
    level, files = spark.createDataFrame([("",)], "own string").coalesce(1), []
    while not level.isEmpty():
        found = written(level.mapInArrow(entries, "own string, length bigint, is_folder boolean"), "listed")
        files.append(found.where("not is_folder").select(F.concat(F.lit(folder), "own").alias("path"), "length"))
        level = found.where("is_folder").select("own").repartition(tasks, "own")
    return reduce(DataFrame.union, files)


def opened(files: DataFrame, folder: str) -> DataFrame:
    """Add `content` to files(path, ...) that listed() found under the folder."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            begin, size, held = 0, 0, []
            paths = batch.column("path").to_pylist()
            for at, path in enumerate(paths):
                with store.open_input_stream(root + path[len(folder):]) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= HELD_BYTES or at == len(paths) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])
                    begin, size, held = at + 1, 0, []
    return files.mapInArrow(read, ", ".join(f"{c} {kind}" for c, kind in files.dtypes) + ", content binary")


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files under a folder. Files are listed and opened by tasks. Every accepted file is opened once
    and stored by its reader, however many readers follow; rejected files are not opened."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = check_files(listed(spark, folder))
    accepted = opened(files.where("verdict = 'ok'").repartition(tasks, "path"), folder)
    path = new_path(spark, "accepted")
    accepted.write.partitionBy("reader").option("parquet.block.size.row.check.min", 1).parquet(path)
    return spark.read.schema(accepted.schema).parquet(path), files.where("verdict <> 'ok'")


def decoded(files: DataFrame) -> DataFrame:
    """(path, reader, text): UTF-8 without byte-order mark, Latin-1 where the bytes are not UTF-8."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return files.select("path", "reader", F.regexp_replace(text, r"^\x{feff}", "").alias("text"))


def documents(files: DataFrame, reader: str) -> DataFrame:
    """Files of one format as (doc_id, text), with the path as document id."""
    return decoded(files.where(F.col("reader") == reader)).select(F.col("path").alias("doc_id"), "text")
