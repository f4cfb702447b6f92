"""Reading structured model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def validate_fields(terms: DataFrame) -> DataFrame:
    """`strategy` wins over `suggested_strategy`; unknown categories become `domain_term`."""
    cat = F.coalesce("ai_category", F.lit(""))
    return (terms.withColumn("strategy", F.coalesce("strategy", "suggested_strategy", F.lit("hard")))
            .withColumn("ai_category", F.when((cat == "") | cat.isin(K.AI_CATEGORIES), cat)
                        .otherwise("domain_term")).drop("suggested_strategy"))


def strip_fences(raw: Column) -> Column:
    body = F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", "")
    return T.strip(F.regexp_replace(body, r"\s*```$", ""))


def json_part(raw: Column) -> Column:
    """The whole reply when it is JSON, else its widest bracketed part, parsed."""
    body = strip_fences(raw)
    whole = F.try_parse_json(body)
    return F.coalesce(whole, F.try_parse_json(F.regexp_extract(body, r"(?s)[\[{].*[}\]]", 0)))


TERM = ("struct<source:string,targets:map<string,string>,category:string,context:string,strategy:string,"
        "suggested_strategy:string,ai_category:string>")


def parse_term_replies(replies: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split replies into (terms, domains, rejected).

    Accepts a list of terms, or an object with `terms` and one or several domains.
    """
    v = F.col("v")
    shaped = replies.select(key, "reply", json_part(F.col("reply")).alias("v")).withColumn(
        "is_list", F.schema_of_variant(v).startswith("ARRAY"))
    listed = F.try_variant_get(v, "$.terms", "array<variant>")
    shaped = shaped.withColumn("items", F.when(F.col("is_list"), F.try_variant_get(v, "$", "array<variant>")).otherwise(listed))
    many = F.filter(F.try_variant_get(v, "$.document_domains", "array<string>"), lambda x: x != "")
    one = F.coalesce(F.nullif(F.try_variant_get(v, "$.document_domain", "string"), F.lit("")), F.lit("general"))
    shaped = shaped.withColumn("raw_domains", F.when(F.col("is_list") | F.col("items").isNull() & v.isNull(), F.array(F.lit("general")))
                               .when(F.size(many) > 0, many).otherwise(F.array(one)))
    items = shaped.select(key, F.posexplode("items").alias("pos", "item"))
    parsed = items.select(key, "pos", F.try_variant_get("item", "$", TERM).alias("t"))
    good = parsed.where("t.source is not null")
    terms = validate_fields(good.select(key, "pos", "t.*"))
    domains = shaped.select(key, F.posexplode("raw_domains").alias("pos", "raw")).select(
        key, "pos", T.normalize_domain(F.col("raw")).alias("domain"))
    rejected = shaped.where("items is null").select(key, "reply")
    return terms, domains, rejected


def parse_gap_replies(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, lang, target) of a list of `{source, translations}`; empty values dropped."""
    rows = replies.select(key, F.explode(F.try_variant_get(
        json_part(F.col("reply")), "$", "array<struct<source:string,translations:map<string,string>>>")).alias("r"))
    return rows.select(key, "r.source", F.explode("r.translations").alias("lang", "target")).where("target <> ''")


def assistant_text(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")
