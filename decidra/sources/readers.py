"""Tables, product facts, static products and paged reviews."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from decidra.functions.scalars import WS
from decidra.schemas import MARKET_SEARCH_RESULT, PRODUCT

_SPACES = re.compile(f"[{WS}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def static_products(spark: SparkSession, path: str) -> DataFrame:
    """Products from a JSON array."""
    return spark.read.schema(PRODUCT).option("multiLine", True).json(path)


def _percent(condition: F.Column) -> F.Column:
    return F.sum(condition.cast("int")) * F.lit(100.0) / F.count(F.lit(1))


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part, its scores from the part's line items.

    Line items are summed by part before the join (map-side combined), so the join sees one row per part."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("review_count"), _percent(F.col("l_quantity") >= 25).alias("cooling"), _percent(F.col("l_tax") < 0.04).alias("quietness"),
        _percent(F.col("l_discount") < 0.05).alias("battery"), _percent(F.col("l_linestatus") == "F").alias("after_service"), _percent(F.col("l_returnflag") != "R").alias("review_score"),
        _percent(F.col("l_linenumber") <= 3).alias("popularity_score"), _percent(F.col("l_returnflag") == "N").alias("availability_score"),
        _percent(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recency_score"), F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("updated_at"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"),
        F.col("p_size").cast("double").alias("weight_kg"), (100 - 2 * F.col("p_size")).cast("double").alias("portability"),
        (F.substring("p_brand", 7, 10).cast("double") * 4).alias("brand_trust_score"), (F.col("p_partkey") % 17 == 0).alias("is_discontinued"),
    )
    facts = part.join(sums, F.col("id") == F.col("l_partkey")).drop("l_partkey")
    return facts.withColumn("sales_rank_score", F.least(F.lit(100), F.col("review_count") * 2).cast("double"))


def market_search(spark: SparkSession, keyword: str) -> DataFrame:
    """The market search, which has no provider: always empty."""
    return spark.createDataFrame([], MARKET_SEARCH_RESULT)


class _Product(InputPartition):
    def __init__(self, product: str, path: str):
        self.product, self.path = product, path


class _ReviewReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.most = options["path"], min(100, max(1, int(options.get("maxreviews", 20))))

    def partitions(self) -> list[InputPartition]:
        return [_Product(p, os.path.join(self.folder, p)) for p in sorted(os.listdir(self.folder))]

    def read(self, partition: _Product) -> Iterator[tuple]:
        size, found = 20, {}
        for page in range(-(-self.most // size)):
            at = os.path.join(partition.path, f"{page}.json")
            if not os.path.exists(at):
                break
            with open(at, encoding="utf-8") as f:
                body = json.load(f)
            if body.get("status", 200) != 200:
                return  # nothing of this product
            rows = body.get("contents")
            rows = rows if isinstance(rows, list) else []
            for pos, r in enumerate(rows):
                own, said = r.get("contentsId"), r.get("reviewContent")
                content = _SPACES.sub(" ", said).strip(" ") if isinstance(said, str) else ""
                if content and len(found) < self.most:
                    found.setdefault(own if isinstance(own, str) else content, (partition.product, page, pos, own, content))
            if len(found) >= self.most or body.get("last") is True or len(rows) < size:
                break
        yield from found.values()  # 100 at most


class ReviewPages(DataSource):
    """A paged review feed: a folder per product with a JSON file per page, which all executors can open. A task reads one
    product's pages in turn, until it has `maxReviews` different reviews, or the last, a short or an empty page; a page whose
    status is not 200 discards the product's reviews. For pages in tables or in remote storage see operators.reviews.collected."""

    @classmethod
    def name(cls) -> str:
        return "reviewpages"

    def schema(self) -> str:
        return "product_id string, page int, pos int, contents_id string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _ReviewReader(self.options)


def review_pages(spark: SparkSession, path: str, max_reviews: int = 20) -> DataFrame:
    spark.dataSource.register(ReviewPages)
    return spark.read.format("reviewpages").option("maxReviews", max_reviews).load(path)
