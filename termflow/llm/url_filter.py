"""URL filter: a blocked Bloom filter of listed prefixes lets possible hits through to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: A block is eight words of 32 bits; a key sets one bit in each word of its block.
WORDS = 8
BITS_PER_KEY = 16
#: Bound of the filter: blocks of WORDS * 4 bytes. A longer list fills it denser, which lets more false
#: positives through to the exact join, never fewer hits.
MAX_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def bloom(keys: DataFrame, key: str = "key") -> DataFrame:
    """(block, word_0 .. word_7): the bits of all keys, joined by block. At most MAX_BLOCKS rows."""
    n = keys.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // (32 * WORDS))))
    bits = keys.select(_block(F.col(key), blocks).alias("block"),
                       *[F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(key), w)).alias(f"word_{w}") for w in range(WORDS)])
    out = bits.groupBy("block").agg(*[F.bit_or(f"word_{w}").alias(f"word_{w}") for w in range(WORDS)])
    return out.withColumn("blocks", F.lit(blocks))


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _bit(key: Column, word: int) -> Column:
    h = F.xxhash64(key, F.lit(2 + word // 4))
    return F.shiftrightunsigned(h, 16 * (word % 4)).bitwiseAND(F.lit(31)).cast("int")


def might_hold(candidates: DataFrame, filter_: DataFrame, key: str = "key") -> DataFrame:
    """Candidates whose bits are all set. The filter has at most MAX_BLOCKS rows, so it is sent whole."""
    blocks = filter_.agg(F.max("blocks")).first()[0] or 1
    held = F.broadcast(filter_.drop("blocks"))
    test = None
    for w in range(WORDS):
        one = F.call_function("shiftrightunsigned", F.col(f"word_{w}"), _bit(F.col(key), w)).bitwiseAND(F.lit(1)) == 1
        test = one if test is None else test & one
    return (candidates.withColumn("block", _block(F.col(key), blocks)).join(held, "block").where(test)
            .drop("block", *[f"word_{w}" for w in range(WORDS)]))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
          otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages`.

    `rules` lists (host, path, verdict): a canonical prefix of URLs. It fits a URL if the host is the
    rule's or below it and the path starts with the rule's; the longest fitting rule decides, `otherwise`
    where none is listed. Of equal rules with several verdicts the first by name counts.
    Distinct (host, path) pairs are tested, so a hot host costs one test of each of its paths; a null URL
    or one without :// has an empty host and path. Repeated rows stay; other columns are not read; with
    no rule every page has `otherwise`.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                          path_of(F.col(url)).alias("path"))
    listed = written(rules.where("host is not null and path is not null").groupBy("host", "path")
                     .agg(F.min("verdict").alias("verdict"))
                     .withColumn("rule", F.concat("host", "path")).withColumn("key", F.concat_ws("\n", "host", "path"))
                     .drop("host", "path"), "url-rules")
    lengths = [r[0] for r in rules.where("host is not null and path is not null")
               .select(F.char_length("path").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    prefixes = F.array_distinct(F.filter(
        F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull()))
    candidates = (judged.select("host", "path").distinct()
                  .withColumn("suffix", F.explode(suffixes(F.col("host"))))
                  .withColumn("prefix", F.explode(prefixes))
                  .select("host", "path", F.concat_ws("\n", "suffix", "prefix").alias("key")))
    hits = might_hold(candidates, bloom(listed)).join(listed, "key")
    longest = hits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct(F.char_length("rule"), "rule")).alias("best"))
    return (judged.join(longest, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")))
