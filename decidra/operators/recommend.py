"""Budget-aware recommendation over five criteria, and market ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.scalars import clamp, count_score, grouped, matches, round1
from decidra.schemas import FIVE_CRITERIA, OVER_BUDGET, STRONG_CRITERION, WITHIN_BUDGET
from decidra.sources.scratch import written


def score(budget: float, weights: dict[str, float]) -> Column:
    """The recommendation score. weights: by criterion, in the order in which products are summed."""
    total = sum(weights.values()) or 1
    fit = F.lit(0.0)
    for criterion, w in weights.items():
        fit = fit + F.col(criterion) * F.lit(float(w))
    price = F.lit(100.0)
    if budget > 0:
        over = (F.col("price") - F.lit(float(budget))) / F.lit(float(budget))
        price = F.when(F.col("price") > budget, F.greatest(F.lit(0.0), F.lit(100.0) - over * 120.0)).otherwise(100.0)
    return fit / F.lit(float(total)) * 0.72 + price * 0.18 + F.col("review_score") * 0.1


def reasons(budget: float, weights: dict[str, float]) -> Column:
    """At most four reasons: the budget, then up to three criteria of 88 or more, heaviest first."""
    ranked = sorted(weights, key=lambda c: -weights[c])  # stable
    strong = F.array_compact(F.array(*(F.when(F.col(c) >= 88, F.lit(f"{FIVE_CRITERIA[c]} {STRONG_CRITERION}")) for c in ranked)))
    within = F.lit(True) if budget == 0 else F.col("price") <= budget
    return F.concat(F.array_compact(F.array(F.when(within, F.lit(WITHIN_BUDGET)))), F.slice(strong, 1, 3))


def cautions(budget: float, cons: Column) -> Column:
    """At most three cautions: how far over the budget, then the first two drawbacks."""
    beyond = F.lit(False) if budget == 0 else F.col("price") > budget
    amount = F.concat(F.lit(OVER_BUDGET[0]), grouped(F.col("price") - F.lit(float(budget))), F.lit(OVER_BUDGET[1]))
    return F.slice(F.concat(F.array_compact(F.array(F.when(beyond, amount))), F.slice(cons, 1, 2)), 1, 3)


def recommend(products: DataFrame, budget: float, weights: dict[str, float], limit: int | None = None) -> DataFrame:
    """Products with score, best first; ties by id."""
    out = products.withColumn("score", round1(score(budget, weights))).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def with_rank(df: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `rank`, the row's place from 1 (within `by`). Without `by`, only for rows that are few by a limit."""
    return df.withColumn("rank", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(*order)))


def rank_all(df: DataFrame, key: Column, id_column: str = "id") -> DataFrame:
    """Adds `rank` by descending key (then id) over any number of rows, without one task that sees them all: rows are
    range-partitioned in order, counted per partition, and numbered from the partition's offset.

    The placed rows are written once, with their partition and place in it. Counts and rows read that table: two plans of the
    same range partitioning would sample different bounds and number different rows. id_column must be unique."""
    order = [F.desc("_key"), F.asc(id_column)]
    placed = df.withColumn("_key", key).repartitionByRange(*order).sortWithinPartitions(*order)
    # the place in the partition is in the low 33 bits
    at = F.monotonically_increasing_id()
    placed = written(placed.select(*df.columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.join(F.broadcast(offsets), "_part")  # a row per partition
    return out.withColumn("rank", (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_at", "_part", "_before")


# --- market


def eligible(category: str = "") -> Column:
    return ~F.col("is_discontinued") & (F.col("availability_score") >= 30) & matches(category, F.col("category"))


def market_parts(most: Column) -> dict[str, Column]:
    """The six parts of the market score, unrounded, in the order of summation."""
    return {
        "sales": clamp(F.col("sales_rank_score")) * 0.3, "review_count_part": clamp(count_score(F.col("review_count"), most)) * 0.25, "rating": clamp(F.col("review_score")) * 0.2,
        "brand_trust": clamp(F.col("brand_trust_score")) * 0.1, "interest": clamp(F.col("popularity_score")) * 0.1, "recency": clamp(F.col("recency_score")) * 0.05,
    }


def _most_reviewed(products: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The products with `_most`, the greatest review count of the eligible ones (of their group), 1 at least."""
    most = products.groupBy(*by).agg(F.greatest(F.lit(1), F.max("review_count")).alias("_most"))
    if by:
        return products.join(most, list(by))
    return products.withColumn("_one", F.lit(1)).join(F.broadcast(most.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row


def market_scored(products: DataFrame, category: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """The eligible products with their market score and its rounded parts."""
    found = _most_reviewed(products.filter(eligible(category)), by)
    parts = market_parts(F.col("_most"))
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    return found.select("*", round1(total).alias("market_score"), *(round1(p).alias(f"part_{name}") for name, p in parts.items())).drop("_most")


MARKET_ORDER = lambda: (F.desc("market_score"), F.desc("availability_score"), F.desc("review_count"), F.col("id"))


def market_top(products: DataFrame, category: str = "", k: int = 5) -> DataFrame:
    return with_rank(market_scored(products, category).orderBy(*MARKET_ORDER()).limit(k), *MARKET_ORDER())


def market_top_by_category(products: DataFrame, k: int = 5) -> DataFrame:
    """The best k of every category."""
    return with_rank(market_scored(products, by=("category",)), *MARKET_ORDER(), by=("category",)).filter(F.col("rank") <= k)


def market_reasons() -> Column:
    # What is said from which score on.
    said = F.array_compact(F.array(
        F.when(F.col("sales_rank_score") >= 85, F.lit("판매 지표가 우수한 시장 인기 제품")),
        F.when(F.col("review_count") >= 1000, F.lit("누적 리뷰가 많아 평가 신뢰도가 높은 제품")).when(F.col("review_count") >= 500, F.lit("충분한 실사용 리뷰가 축적된 제품")),
        F.when(F.col("review_score") >= 88, F.lit("실사용자 만족도가 높은 제품")), F.when(F.col("brand_trust_score") >= 85, F.lit("브랜드와 고객지원 신뢰도가 높은 제품")),
        F.when(F.col("popularity_score") >= 85, F.lit("시장 관심도와 인지도가 높은 제품")), F.when(F.col("recency_score") >= 85, F.lit("비교적 최신 제품으로 시장성이 유지되는 제품")),
        F.when(F.col("availability_score") >= 85, F.lit("현재 구매 가능성과 유통 접근성이 좋은 제품")),
    ))
    return F.when(F.size(said) == 0, F.array(F.lit("판매, 리뷰, 브랜드, 관심도를 종합한 시장 점수가 양호한 제품"))).otherwise(said)
