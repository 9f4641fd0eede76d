"""Review cleaning, and analysis of reviews by a pluggable function."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.exchange import transfer
from decidra.functions.scalars import collapse, score_number, strip_code_fence, trim, whole_score
from decidra.schemas import CRITERION_LABELS, NO_EVIDENCE


def review_lines(text: Column) -> Column:
    """The non-empty lines of a text, white space collapsed."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), collapse), lambda s: s != "")


def distinct_reviews(text: Column, most: int = 100) -> Column:
    """A text's lines as reviews: each once, in order, at most `most`."""
    return F.slice(F.array_distinct(review_lines(text)), 1, most)


def dedupe_by_key(reviews: DataFrame, group: str, key: Column, content: str, order: list[str], most: int | None = None) -> DataFrame:
    """Reviews with content, the first of every key (or of every content, where there is no key) in each group.

    First the earliest place per (group, key) by a map-side combined aggregate, then places within the group."""
    own = reviews.withColumn(content, collapse(F.col(content))).filter(F.col(content) != "").withColumn("_key", F.coalesce(key, F.col(content)))
    first = own.groupBy(group, "_key").agg(F.min(F.struct(*order, content)).alias("_first")).select(group, "_first.*")
    numbered = first.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.filter(F.col("pos") <= most) if most else numbered


def first_messages(messages: DataFrame, tag: str) -> DataFrame:
    """product, at, reviews: the first message of type `tag` of each product (product, at, message). It is the only one that is
    processed, even if it is about another product: then its reviews are null."""
    kind = F.try_variant_get(F.try_parse_json("message"), "$.type", "string")
    first = messages.filter(kind == tag).groupBy("product").agg(F.min(F.struct("at", "message")).alias("_m")).select("product", "_m.*")
    return first.select("product", "at", transfer(F.col("message"), tag, F.col("product").cast("string")).alias("reviews"))


def collected(pages: DataFrame, most: int = 20, size: int = 20) -> DataFrame:
    """product, pos, content: the reviews that reading the pages of a feed in turn gives, at most `most` different ones.

    pages: product, page (from 0), status, last, contents (id, content). As many pages are read as `most` needs; a short one,
    the last one, or enough reviews end it. A page that is reached with another status than 200 fails the product: none
    of its reviews is given. A review without content is skipped; one without id is known by its content."""
    asked = pages.filter(F.col("page") < -(-most // size))
    bad = F.coalesce(F.col("status"), F.lit(200)) != 200
    ends = bad | F.coalesce("last", F.lit(False)) | (F.coalesce(F.size("contents"), F.lit(0)) < size)
    ended = asked.filter(ends).groupBy("product").agg(F.min(F.struct("page", bad.alias("bad"))).alias("_end"))
    read = asked.join(ended, "product", "left").filter(~bad & (F.col("_end").isNull() | (F.col("page") <= F.col("_end.page"))))
    each = read.select("product", "page", F.posexplode("contents").alias("at", "r")).select("product", "page", "at", "r.id", "r.content")
    found = dedupe_by_key(each, "product", F.col("id"), "content", ["page", "at"], most)
    found = found.withColumn("_n", F.max("pos").over(Window.partitionBy("product")))  # at most `most` rows
    failed = ended.filter("_end.bad").select("product", F.lit(True).alias("_bad"))
    return found.join(failed, "product", "left").filter(F.col("_bad").isNull() | (F.col("_n") >= most)).select("product", "pos", "content")


# --- analysis


def stub_analyzer(product: str, reviews: list[str]) -> str:
    """A deterministic stand-in for a language model: counts, and scores from lengths."""
    scores = {k: (sum(map(len, reviews)) * (i + 3)) % 101 if reviews else None for i, k in enumerate(CRITERION_LABELS)}
    return json.dumps({"productName": product, "reviewCount": len(reviews), "summary": reviews[0][:40] if reviews else "", "criterionScores": scores, "confidenceScore": min(100, 5 * len(reviews))})


def analyze(reviews: DataFrame, analyzer: Callable[[str, list[str]], str] = stub_analyzer, most: int = 200) -> DataFrame:
    """product, analysis (JSON text) from reviews (product, pos, review). A product's reviews are cut to `most` before they
    are gathered, so a group is bounded."""
    few = reviews.withColumn("_n", F.row_number().over(Window.partitionBy("product").orderBy("pos"))).filter(F.col("_n") <= most)
    lists = few.groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "review"))), lambda x: x["review"]).alias("reviews"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"product": batch["product"], "analysis": [analyzer(str(p), list(r)) for p, r in zip(batch["product"], batch["reviews"], strict=True)]})

    return lists.mapInPandas(run, f"product {lists.schema['product'].dataType.simpleString()}, analysis string")


def normalized(analyses: DataFrame, analysis: str = "analysis") -> DataFrame:
    """The analyses' other columns, key, score, reason: a row for each analysis and fixed criterion, whatever the analysis says.

    Every step is a select of its own, so a text is parsed once for all criteria: expressions in which one value stands in many
    places (in maps and generators above all) would parse it anew for each of them."""
    own = [c for c in analyses.columns if c != analysis]
    criteria = "struct<" + ",".join(f"{k}:variant" for k in CRITERION_LABELS) + ">"
    part = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", criteria).alias(f"_{name}")
    parsed = analyses.select(*own, F.try_parse_json(strip_code_fence(F.col(analysis))).alias("_v"))
    parts = parsed.select(*own, part("criterionScores"), part("criterionReasons"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"_criterionScores.{k}").alias("_score"), F.col(f"_criterionReasons.{k}").alias("_reason")) for k in CRITERION_LABELS))
    each = parts.select(*own, F.inline(pairs))
    reason = F.when(F.schema_of_variant("_reason") == "STRING", trim(F.try_variant_get(F.col("_reason"), "$", "string"))).otherwise(NO_EVIDENCE)
    found = each.select(*own, "key", score_number(F.col("_score")).alias("_x"), reason.alias("reason"))
    return found.select(*own, "key", whole_score(F.col("_x")).alias("score"), "reason")
