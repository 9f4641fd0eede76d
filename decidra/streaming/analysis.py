"""Analyses of products that follow their reviews as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from decidra.functions.scalars import WS_CHARS, collapse
from decidra.operators.reviews import stub_analyzer
from decidra.streaming import feed

ANALYSIS = "product string, n int, analysis string"
STATE = "reviews array<string>"
#: White space that collapsing changes: all but a single space.
_CHANGED = f" [{WS_CHARS}]+|[{WS_CHARS.replace(' ', '')}][{WS_CHARS}]*"


def analyses_stream(reviews: DataFrame, analyzer: Callable[[str, list[str]], str] = stub_analyzer, most: int = 200) -> DataFrame:
    """product, n, analysis (JSON text) for a stream of reviews (product, pos, review): a new row whenever a product's first
    `most` different reviews have changed, so the last row of a product (the one with the greatest n) is what
    operators.reviews.analyze gives for all that has arrived.

    Reviews are collapsed; empty ones, null and known ones count for nothing. Within a batch they count by pos, then text; between
    batches by arrival, so a feed must not go back in pos. The state of a product is those reviews, at most `most`; with that many
    it changes no more, and its analyzer is not asked again. In a batch a product's rows come to one task in chunks, of which only what
    can still count is kept.

    A product costs a call in pandas and a state row in memory for each batch (some 3 ms); analyses_published gives the same for many."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get[0]) if state.exists else []
        room = most - len(known)
        first: dict[str, tuple[int, str]] = {}
        seen = set(known)
        for batch in batches:
            if room == 0:
                continue
            for pos, text in zip(batch["pos"], batch["review"], strict=True):
                if text not in seen and (text not in first or pos < first[text][0]):
                    first[text] = (pos, text)
            if len(first) > 2 * room + 1000:
                first = {text: at for at, text in sorted((at, text) for text, at in first.items())[:room]}
        added = sorted(first.values())[:room]
        if added:
            known += [text for _, text in added]
            state.update((known,))
            yield pd.DataFrame({"product": [key[0]], "n": [len(known)], "analysis": [analyzer(key[0], known)]})

    clean = reviews.select(F.col("product").cast("string").alias("product"), F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), collapse(F.col("review")).alias("review"))
    clean = clean.filter("product is not null and review <> ''")
    return clean.groupBy("product").applyInPandasWithState(follow, ANALYSIS, STATE, "update", GroupStateTimeout.NoTimeout)


def analyses_published(path: str, analyzer: Callable[[str, list[str]], str] = stub_analyzer, most: int = 200) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of reviews (product, pos, review): what analyses_stream gives, published as feed.published
    does, and with it the reviews that each product has gained. Those of the batches before are all the state there is: they are
    read, for the products of the batch, and each review is written once. Joins, grouping and a window do the work, so
    nothing is called for each product but its analyzer, and what does not fit in memory spills. A batch reads the whole of what was
    published before, so many reviews should come in a batch. Batches after this one count for nothing, so a batch that
    comes again gives what it gave before."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            review = pc.utf8_trim(pc.replace_substring_regex(batch.column("review"), _CHANGED, " "), " ")
            yield pa.RecordBatch.from_arrays([batch.column("product"), batch.column("pos"), review], names=["product", "pos", "review"])

    def analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("reviews").to_pylist()
            texts = [analyzer(p, r) for p, r in zip(batch.column("product").to_pylist(), lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("product"), pa.array([len(r) for r in lists], pa.int32()), pa.array(texts, pa.string()), batch.column("added")], names=["product", "n", "analysis", "added"])

    def write(batch: DataFrame, number: int) -> None:
        own = batch.select(F.col("product").cast("string").alias("product"), F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), F.col("review").cast("string").alias("review")).filter("product is not null")
        # rows go to their product's task once; the order in which a list is cut is theirs, and what is known takes up at most as much room
        rows = own.mapInArrow(clean, own.schema).filter("review <> ''").repartition("product").groupBy("product", "review").agg(F.min("pos").alias("pos"))
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("product").orderBy("pos", "review"))).filter(F.col("_n") <= most)
        found = first.groupBy("product").agg(F.array_sort(F.collect_list(F.struct("_n", "review")))["review"].alias("_found"))
        before = feed.earlier(batch.sparkSession, path, number)
        if before is None:
            found = found.withColumn("_known", F.array().cast("array<string>"))
        else:
            met = before.join(own.select("product").distinct(), "product", "left_semi")
            known = met.groupBy("product").agg(F.flatten(F.array_sort(F.collect_list(F.struct("batch", "added")))["added"]).alias("_known"))
            found = found.join(known, "product", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
        added = F.slice(F.array_except("_found", "_known"), F.lit(1), most - F.size("_known"))
        changed = found.select("product", "_known", added.alias("added")).filter(F.size("added") > 0)
        texts = changed.select("product", F.concat("_known", "added").alias("reviews"), "added")
        texts.mapInArrow(analysed, f"{ANALYSIS}, added array<string>").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str) -> DataFrame:
    """product, n, analysis: the last of each product that feed.published or analyses_published has written there. A product's rows are merged where they
    are read, as max_by keeps one of them."""
    rows = spark.read.schema(f"{ANALYSIS}, batch int").parquet(path)
    last = rows.groupBy("product").agg(F.max_by(F.struct("n", "analysis"), "batch").alias("_last"))
    return last.select("product", "_last.*")
