"""Building blocks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

SALTS = 16


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate of a table is under its broadcast limit."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size) <= limit


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], spread: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join of a large, possibly skewed table with a smaller keyed one.

    A side whose estimated size is under the broadcast limit is broadcast, so nothing is moved.
    Beyond that, rows of a hot key are spread over `salts` tasks by a hash of the `spread` columns;
    the other side is repeated once per salt. The hash depends on data only, so a rebuilt
    task sends its rows to the same place.
    """
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), keys, how)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Place of every row in one total order, without a task that sees all rows.

    Rows are dealt out by ranges of the order and stored with the number of their range, so counting
    and numbering see the same ranges; the offsets have one row per range.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (dealt.withColumn("_inside", inside).join(offsets, "_range")
            .withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_inside", "_before", "_range"))


def _chunk_window(keys, chunk):
    return Window.partitionBy(*keys, chunk)


def lag_by_chunk(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                 value: Column, out: str) -> DataFrame:
    """Previous value of an ordered group, computed one chunk of the group at a time.

    `chunk` must not decrease along `order`. Only one row per chunk crosses chunk borders.
    """
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    w = _chunk_window(keys, "_chunk").orderBy(*order)
    inside = cut.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_lagged", F.lag(F.struct("_value")).over(w))
    tails = cut.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct("_value"), F.struct(*order)).alias("_tail"))
    border = tails.withColumn("_before", F.lag("_tail").over(
        Window.partitionBy(*keys).orderBy("_chunk"))).drop("_tail")
    first = F.col("_rn") == 1
    return (inside.join(border, [*keys, "_chunk"], "left")
            .withColumn(out, F.when(first, F.col("_before._value")).otherwise(F.col("_lagged._value")))
            .drop("_chunk", "_value", "_rn", "_lagged", "_before"))


def running_sum_by_chunk(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                         value: Column, out: str) -> DataFrame:
    """Running sum over an ordered group from chunk totals plus a sum inside each chunk."""
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = cut.withColumn("_part", F.sum("_value").over(
        _chunk_window(keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_total")
    return (inside.join(offsets, [*keys, "_chunk"])
            .withColumn(out, F.col("_part") + F.col("_offset"))
            .drop("_chunk", "_value", "_part", "_offset"))
