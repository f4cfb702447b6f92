"""The term library as stored tables: changed bucket by bucket, listed page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import maps as M
from ..session import new_path, written
from ..skew import running_sum_by_chunk
from ..tables import BUCKETS, BucketTable
from .library import META, premerge


class StoredLibrary:
    """A library (id, domain_id, norm, source, targets, strategy, ...) in buckets by (domain_id, norm).

    An import batch reads and overwrites the buckets of its terms; all others stay as they are, so its cost
    follows the batch. New terms get the next ids, in the order of the batch, from a counter that
    is stored beside the library and moved on first: an import that is repeated under its version after
    a failure gives its terms the same ids.
    """

    def __init__(self, spark: SparkSession, path: str | None, schema: StructType, buckets: int = BUCKETS):
        self.spark = spark
        path = path or new_path(spark, "stored-library")
        fields = {f.name: f for f in schema.fields}
        self.columns = ["id", "domain_id", "norm", "source", "targets", *META]
        self.rows = BucketTable(spark, f"{path}/terms", StructType([fields[c] for c in self.columns]), ["domain_id", "norm"], buckets)
        counter = StructType([StructField("name", StringType()), StructField("top", LongType())])
        self.counter = BucketTable(spark, f"{path}/counter", counter, ["name"], 1)

    def read(self) -> DataFrame:
        return self.rows.read()

    def load(self, library: DataFrame) -> None:
        """First content: a library with ids of its own."""
        rows = written(library.select(self.columns), "library-load")
        self.rows.update(rows, lambda old, new: new, "load")
        self._reserve(rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], "load")

    def _reserve(self, n: int, version: str) -> int:
        """Move the counter on by n; its new value."""
        more = self.spark.createDataFrame([("id", n)], self.counter.schema)
        self.counter.update(more, lambda old, new: old.unionByName(new).groupBy("name").agg(F.sum("top").alias("top")), version)
        return self.counter.read().first()["top"]

    def upsert(self, batch: DataFrame, version: str, chunk_rows: int = 100_000) -> list[int]:
        """Import a batch as `library.upsert` would; returns the buckets it touched."""
        new = written(premerge(batch), "library-batch")
        known = self.touched_terms(new)
        added = new.join(known, ["domain_id", "norm"], "left_anti")
        numbered = running_sum_by_chunk(added, [], ["first_row"], F.floor(F.col("first_row") / chunk_rows), F.lit(1), "_no")
        numbered = written(numbered.select("domain_id", "norm", "_no"), "library-new")
        n = numbered.count()
        top = self._reserve(n, version) - n
        ids = known.unionByName(numbered.select("domain_id", "norm", (F.col("_no") + top).alias("id")))
        changes = new.join(ids, ["domain_id", "norm"]).select(self.columns)
        return self.rows.update(changes, self._merged, version)

    def touched_terms(self, new: DataFrame) -> DataFrame:
        """(domain_id, norm, id) of the stored terms of a batch, from the buckets it touches."""
        return (self.rows.read(self.rows.touched(new)).select("domain_id", "norm", "id")
                .join(new.select("domain_id", "norm"), ["domain_id", "norm"], "left_semi"))

    def _merged(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.alias("o").join(new.alias("n"), ["domain_id", "norm"], "full")
        pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return both.select(pick("id"), "domain_id", "norm", pick("source"), M.upsert(F.col("o.targets"), F.col("n.targets")).alias("targets"),
                           *[pick(c) for c in META])


class TermPages:
    """A library in ranges of (domain_id, norm, id), with a directory of how many terms of a domain each
    range holds; a page is found in the directory and read from the ranges it lies in."""

    def __init__(self, library: DataFrame, ranges: int | None = None, path: str | None = None):
        self.spark = library.sparkSession
        self.path = path or new_path(self.spark, "term-pages")
        order = ["domain_id", "norm", "id"]
        dealt = library.repartitionByRange(ranges, *order) if ranges else library.repartitionByRange(*order)
        dealt.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(f"{self.path}/terms")
        self.rows = self.spark.read.schema(dealt.withColumn("range", F.lit(0)).schema).parquet(f"{self.path}/terms")
        self.directory = written(self.rows.groupBy("domain_id", "range").agg(F.count("*").alias("n")), "term-directory")

    def page(self, domain_id: int, search: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
        """A page of one domain by normalised source, with the total count beside every row.

        `%` and `_` in the search text act as wildcards. With a search, the ranges of the domain count
        their hits first; only those that the page lies in are sorted."""
        here = self.directory.where(F.col("domain_id") == domain_id)
        hits = self.rows.where(F.col("domain_id") == domain_id)
        if search:
            hits = hits.where(F.col("norm").like(f"%{search.strip().lower()}%"))
            inside = [r["range"] for r in here.select("range").collect()]
            here = hits.where(F.col("range").isin(inside)).groupBy("range").agg(F.count("*").alias("n"))
        order = Window.orderBy("range")  # one row for each range of a domain
        placed = here.select("range", "n", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
        found = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("range").collect()
        if not found:
            return hits.drop("range").withColumn("total", F.lit(0).cast("bigint")).where("false")
        rows = hits.where(F.col("range").isin([r["range"] for r in found])).drop("range")
        return (rows.orderBy("norm", "id").offset(offset - found[0]["before"]).limit(limit)
                .withColumn("total", F.lit(found[0]["total"]).cast("bigint")))
