"""JSON request bodies as rows: fields read as their producers mean them, guards, and lookups that must find one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.scalars import json_number, requested_reviews, to_number, trim


def number_field(body: Column, name: str, path: str | None = None) -> Column:
    """A field as a number: texts are read, true is 1, null is 0; null where it is missing or no number."""
    value = F.try_variant_get(body, path or f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "STRING", to_number(text)).when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0)).when(kind == "VOID", 0.0).otherwise(json_number(value))


def text_field(body: Column, name: str) -> Column:
    """A field's text, trimmed; null where it is missing or no text."""
    value = F.try_variant_get(body, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", trim(F.try_variant_get(value, "$", "string")))


def texts_field(body: Column, name: str, most: int = 200) -> Column:
    """A field's texts that are not blank, trimmed, at most `most`; empty where it is no array."""
    value = F.try_variant_get(body, f"$.{name}", "variant")
    raw = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    texts = F.transform(F.filter(raw, lambda r: F.schema_of_variant(r) == "STRING"), lambda r: trim(F.try_variant_get(r, "$", "string")))
    return F.slice(F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>")), 1, most)


def guarded(requests: DataFrame, guards: dict[str, Column]) -> DataFrame:
    """requests with `rejected`: the name of the first guard that does not hold (null counts as not), null where all do.

    The rows with and those without a name are the two outputs; together they are the input."""
    failing = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in guards.items()))
    return requests.withColumn("rejected", failing)


def collection_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests to collect reviews, read from JSON bodies: merchant_no, origin_no, max_reviews, rejected."""
    v = F.try_parse_json(body)
    read = requests.withColumns({"_v": v, "_object": F.schema_of_variant(v).startswith("OBJECT")})
    asked = F.try_variant_get("_v", "$.maxReviews", "variant")
    most = F.when(asked.isNull() | (F.schema_of_variant(asked) == "VOID"), F.lit(20.0)).otherwise(number_field(F.col("_v"), "maxReviews"))
    read = read.withColumns({"_merchant": number_field(F.col("_v"), "checkoutMerchantNo"), "_origin": number_field(F.col("_v"), "originProductNo"), "max_reviews": requested_reviews(most).cast("int")})
    whole = lambda c: (F.col(c) == F.floor(c)) & (F.col(c) > 0)
    out = guarded(read, {"body": F.col("_object"), "checkoutMerchantNo": whole("_merchant"), "originProductNo": whole("_origin")})
    sound = F.col("rejected").isNull()
    return out.withColumns({"merchant_no": F.when(sound, F.col("_merchant").cast("long")), "origin_no": F.when(sound, F.col("_origin").cast("long")), "max_reviews": F.when(sound, F.col("max_reviews"))}).drop("_v", "_object", "_merchant", "_origin")


def analysis_requests(requests: DataFrame, category: str, body: str = "body") -> DataFrame:
    """Requests to analyse reviews: product, category (the given one where there is none), reviews, rejected."""
    v = F.try_parse_json(body)
    read = requests.withColumn("_v", v)
    read = read.withColumns({"product": text_field(F.col("_v"), "productName"), "category": F.coalesce(text_field(F.col("_v"), "category"), F.lit(category)), "reviews": texts_field(F.col("_v"), "reviews")})
    return guarded(read, {"body": F.schema_of_variant("_v").startswith("OBJECT"), "productName": F.col("product") != "", "reviews": F.size("reviews") > 0}).drop("_v")


def responded(requests: DataFrame, rows: DataFrame, key: str, row_key: str) -> DataFrame:
    """guarded() requests with `status`: 400 for a rejected one, 404 where no row has its key, 409 where several have, else 200.

    Rows are counted by key before they are joined, so a key of very many rows costs one. A missing key is found nowhere."""
    there = rows.filter(F.col(row_key).isNotNull()).groupBy(F.col(row_key).alias(key)).agg(F.count("*").alias("_n"))
    found = requests.join(there, key, "left")
    status = F.when(F.col("rejected").isNotNull(), 400).when(F.col("_n").isNull(), 404).when(F.col("_n") > 1, 409).otherwise(200)
    return found.withColumn("status", status).drop("_n")


def looked_up(wanted: DataFrame, rows: DataFrame, key: str, required: bool = True) -> DataFrame:
    """wanted (key, ...) with the columns of the one row of `rows` that has each key; without a row, nulls, if not required.

    The query fails when it runs, naming the key, if a key has several rows, or none where one is required. Rows are counted by
    key and cut to two before they are joined, so a key with very many rows costs two."""
    number = Window.partitionBy(key).orderBy(F.lit(1))
    few = rows.withColumn("_n", F.row_number().over(number)).filter("_n <= 2")
    several = F.max("_n").over(Window.partitionBy(key))
    found = few.withColumn("_several", several).filter("_n = 1")
    joined = wanted.join(found, key, "left")
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    check = F.when(F.col("_several") > 1, told("several rows"))
    if required:
        check = check.when(F.col("_n").isNull(), told("no row"))
    # the assertion stands in a filter that keeps every row, so no plan can drop it
    return joined.filter(F.coalesce(check.cast("boolean"), F.lit(True))).drop("_n", "_several")
