"""Keyed tables that change in place: rows lie in buckets by a hash of their key, and a change reads and
overwrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Buckets of a table; choose them so that one bucket is a few files' work.
BUCKETS = 16


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BucketTable:
    """A table of `schema` under `path`, in buckets by `keys`.

    `update` first writes the new content of the touched buckets beside the table and then puts it in
    their place. A change that is made again under its version (a batch after a restart) takes up the
    content written then, whatever part of it is in place already, so it counts once. What an older
    version left beside the table is cleared by the next one. Readers see a bucket before or after a change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema
        self.stored = StructType([*schema.fields, StructField("bucket", IntegerType())])
        if not _exists(spark, path):
            spark.createDataFrame([], self.stored).write.mode("ignore").partitionBy("bucket").parquet(path)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; the scan is pruned to them."""
        rows = self.spark.read.schema(self.stored).parquet(self.path)
        return (rows if touched is None else rows.where(F.col("bucket").isin(touched))).select(self.schema.fieldNames())

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of some keys: one number a bucket at most."""
        return sorted(r[0] for r in changes.select(bucket_of(self.keys, self.buckets)).distinct().collect())

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: str) -> list[int]:
        """Put merge(old rows of the touched buckets, changes) in their place; returns the buckets.

        A bucket that loses its last row must keep one, which `merge` has to see to (a marked row).
        """
        beside = f"{self.path}-beside/{version}"
        known = _exists(self.spark, f"{beside}/content/_SUCCESS")
        if not known:
            _remove(self.spark, f"{self.path}-beside")
        # Written even where the content is known, so that a stream's state goes the same way as the first time.
        changes.write.mode("overwrite").parquet(f"{beside}/changes")
        if not known:
            changes = self.spark.read.schema(changes.schema).parquet(f"{beside}/changes")
            new = merge(self.read(self.touched(changes)), changes).select(self.schema.fieldNames())
            (new.withColumn("bucket", bucket_of(self.keys, self.buckets)).repartition("bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{beside}/content"))
        content = self.spark.read.schema(self.stored).parquet(f"{beside}/content")
        buckets = sorted(r[0] for r in content.select("bucket").distinct().collect())
        if buckets:
            content.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return buckets


def latest_wins(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the changes, and the old rows whose key they do not have."""
    return changes.unionByName(old.join(changes.select(*keys).distinct(), keys, "left_anti"))
