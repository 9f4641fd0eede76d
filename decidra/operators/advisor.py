"""Weighted-criteria advisor: match, coverage and confidence of products against weights, and the weights themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.scalars import clamp, fixed1, json_coerced, json_points, json_texts, number_text, round_half_up, usable_score
from decidra.operators.recommend import with_rank
from decidra.schemas import CRITERION_LABELS, GOOD_SCORE, LOW_SCORE, NO_REASON_STORED, NO_SUMMARY


def clean_weights(weights: object) -> dict[str, float]:
    """Weights as sent by a caller: numbers within 0 to 10, in order; what is no number is left out."""
    out: dict[str, float] = {}
    for key, value in weights.items() if isinstance(weights, dict) else ():
        try:
            x = 0.0 if value is None or value == "" else float(value)
        except (TypeError, ValueError):
            continue
        if x == x and abs(x) != float("inf"):
            out[key] = max(0.0, min(10.0, x))
    return out


def active(weights: dict[str, float]) -> dict[str, float]:
    """The weights above 0. ValueError if there are none."""
    found = {k: float(w) for k, w in weights.items() if w > 0}
    if not found:
        raise ValueError("at least one weight must be above 0")
    return found


def measures(weights: dict[str, float], scores: dict[str, Column], confidence: Column) -> dict[str, Column]:
    """used, match_score, coverage and confidence, an expression per criterion added up in the weights' order.

    The weights are known when the plan is made, so no join or shuffle comes before the top-k."""
    total, used = F.lit(0.0), F.lit(0.0)
    for key, w in weights.items():
        s = usable_score(scores[key]) if key in scores else F.lit(None).cast("double")
        total = total + F.when(s.isNotNull(), s * F.lit(w)).otherwise(0.0)
        used = used + F.when(s.isNotNull(), F.lit(w)).otherwise(0.0)
    asked = 0.0
    for w in weights.values():
        asked += w
    coverage = round_half_up(used / F.lit(max(1.0, asked)) * 100)
    # a missing confidence counts as 0; NaN, like a text that is no number, leaves it unknown
    known = F.coalesce(confidence, F.lit(0.0))
    own = F.when(~F.isnan(known), clamp(known))
    return {"used": used, "match_score": round_half_up(total / used), "coverage": coverage, "confidence": round_half_up(coverage * 0.7 + own * 0.3)}


def breakdown(weights: dict[str, float], scores: dict[str, Column], reasons: Column | None = None) -> Column:
    """An array of (ord, key, label, score, weight, contribution, reason), heaviest first, then in the weights' order."""
    rows = []
    for k, (key, w) in enumerate(weights.items()):
        s = usable_score(scores[key]) if key in scores else F.lit(None).cast("double")
        reason = F.try_element_at(reasons, F.lit(key)) if reasons is not None else F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(k).alias("ord"), F.lit(key).alias("key"), F.lit(CRITERION_LABELS.get(key, key)).alias("label"), s.alias("score"), F.lit(w).alias("weight"),
            fixed1(s * F.lit(w)).alias("contribution"), F.coalesce(reason, F.lit(NO_REASON_STORED)).alias("reason"),
        ))
    order = sorted(range(len(rows)), key=lambda k: -list(weights.values())[k])
    return F.array(*(rows[k] for k in order))


def _sorted(items: Column, key, descending: bool, k: int) -> Column:
    """The first k items with a score, by key, then in the weights' order."""
    sign = -1 if descending else 1
    keyed = F.transform(F.filter(items, lambda x: x["score"].isNotNull()), lambda x: F.struct((key(x) * sign).alias("by"), x["ord"].alias("ord"), x.alias("item")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["item"])


def strongest(items: Column, k: int = 3) -> Column:
    return _sorted(items, lambda x: x["score"] * x["weight"], True, k)


def weakest(items: Column, k: int = 2) -> Column:
    return _sorted(items, lambda x: x["score"], False, k)


def heaviest(items: Column, k: int = 4) -> Column:
    return _sorted(items, lambda x: x["weight"], True, k)


def reason_texts(items: Column) -> Column:
    return F.transform(strongest(items), lambda x: F.concat(x["label"], F.lit(GOOD_SCORE[0]), number_text(x["weight"]), F.lit(GOOD_SCORE[1]), number_text(x["score"]), F.lit(GOOD_SCORE[2])))


def caution_texts(items: Column, cautions: Column, negatives: Column) -> Column:
    """At most four, each once: two cautions, two negative points, then the weakest criteria."""
    weak = F.transform(weakest(items), lambda x: F.concat(x["label"], F.lit(LOW_SCORE[0]), number_text(x["score"]), F.lit(LOW_SCORE[1])))
    return F.slice(F.array_distinct(F.concat(cautions, negatives, weak)), 1, 4)


def advise(products: DataFrame, weights: dict[str, float], scores: dict[str, Column], confidence: Column, category: str | None = None, k: int = 5) -> DataFrame:
    """The best k analysed products (of a category) with match_score, coverage, confidence and rank."""
    weights = active(weights)
    found = products.filter(F.col("review_analysis").isNotNull())
    found = found if category is None else found.filter(F.col("category") == category)
    found = found.withColumns(measures(weights, scores, confidence)).filter("used > 0")
    order = (F.desc("match_score"), F.desc_nulls_last("confidence"), F.col("id"))
    return with_rank(found.orderBy(*order).limit(k), *order)


def stored_reasons(analysis: Column, keys: list[str]) -> Column:
    """The texts that an analysis (a variant) gives for these criteria, as a map; under its older name if need be."""
    new, old = (F.try_variant_get(analysis, f"$.{name}", "variant") for name in ("criterionReasons", "criterion_reasons"))
    own = F.when(F.coalesce(F.schema_of_variant(new), F.lit("VOID")) != "VOID", new).otherwise(old)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.create_map(*(x for k in keys for x in (F.lit(k), text(F.try_variant_get(own, f"$.{k}", "variant")))))


def answers(products: DataFrame, weights: dict[str, float], scores: dict[str, Column], category: str | None = None, k: int = 5) -> DataFrame:
    """advise() over analyses as they are stored (review_analysis, JSON text), with all that is shown: review_count, summary,
    reasons, cautions, best_for and criteria (the breakdown), for the k rows that stay alone."""
    weights = active(weights)
    v = F.try_parse_json("review_analysis")
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    best = advise(products.withColumns({f"_{key}": c for key, c in scores.items()}), weights, {key: F.col(f"_{key}") for key in scores}, json_coerced(part("confidenceScore")), category, k)
    best = best.withColumn("criteria", breakdown(weights, {key: F.col(f"_{key}") for key in scores}, stored_reasons(v, list(weights))))
    items = F.col("criteria")
    return best.withColumns({
        "review_count": json_coerced(part("reviewCount")), "summary": F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(NO_SUMMARY)),
        "reasons": reason_texts(items), "cautions": caution_texts(items, json_texts(part("cautions"), 2), json_points(part("negativePoints"), 2)), "best_for": json_texts(part("bestFor"), 3),
    }).drop("used", *(f"_{key}" for key in scores))


def advise_all(products: DataFrame, weights: dict[str, float], scores: dict[str, Column], confidence: Column, k: int = 5) -> DataFrame:
    """advise() for every category at once."""
    found = products.filter(F.col("review_analysis").isNotNull()).withColumns(measures(active(weights), scores, confidence)).filter("used > 0")
    return with_rank(found, F.desc("match_score"), F.desc_nulls_last("confidence"), F.col("id"), by=("category",)).filter(F.col("rank") <= k)


def advise_long(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """id, match_score, coverage for weights that come as a table (key, weight, ord): scores is (id, key, score).

    Products are added up in the weights' order, whatever order the shuffle gives. Weights are a request's few rows; products
    without any usable score drop out."""
    added = lambda items, x: F.aggregate(items, F.lit(0.0), lambda s, i: s + x(i))
    asked = weights.agg(F.array_sort(F.collect_list(F.struct("ord", "weight"))).alias("_asked"))
    asked = asked.select(F.greatest(F.lit(1.0), added("_asked", lambda i: i["weight"])).alias("asked"), F.lit(1).alias("_one"))
    own = scores.join(F.broadcast(weights), "key").withColumn("score", usable_score(F.col("score"))).filter("score is not null")
    items = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "score", "weight"))).alias("items"))
    sums = items.select("id", added("items", lambda i: i["score"] * i["weight"]).alias("t"), added("items", lambda i: i["weight"]).alias("u"), F.lit(1).alias("_one"))
    sums = sums.join(F.broadcast(asked), "_one")  # one row
    return sums.select("id", round_half_up(F.col("t") / F.col("u")).alias("match_score"), round_half_up(F.col("u") / F.col("asked") * 100).alias("coverage"))


# --- weights from answers

# What an answer adds to which weight, in the order in which new weights are appended.
RULES = [
    ("people", "3_4", "cooling_capacity", 1), ("people", "5_plus", "cooling_capacity", 2), ("people", "5_plus", "power_consumption", 1),
    ("space", "car", "noise", 2), ("space", "car", "portability", 1), ("space", "car", "installation", 1), ("space", "large_tent", "cooling_capacity", 2), ("space", "large_tent", "installation", 1),
    ("space", "caravan", "noise", 1), ("space", "caravan", "drainage", 1), ("space", "caravan", "durability_service", 1),
    ("power", "power_station", "power_consumption", 2), ("power", "power_station", "power_compatibility", 2), ("power", "inverter", "power_consumption", 1), ("power", "inverter", "power_compatibility", 2),
    ("power", "not_sure", "power_compatibility", 1), ("budget", "under_300", "value", 3), ("budget", "under_500", "value", 2), ("budget", "under_800", "value", 1),
    ("sleep_use", "true", "noise", 2), ("frequent_move", "true", "portability", 2), ("frequent_move", "true", "installation", 1),
]


def adjusted_weights(weights: DataFrame, answers: DataFrame) -> DataFrame:
    """session, key, weight, ord for weights (session, key, weight, ord) and answers (session, question, answer).

    All rules add, so one clamp to 10 after the sum equals one after each step. New keys come behind, in rule order."""
    spark = weights.sparkSession
    rules = spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], "question string, answer string, key string, delta int, at int")
    added = answers.join(F.broadcast(rules), ["question", "answer"]).groupBy("session", "key").agg(F.sum("delta").alias("delta"), F.min("at").alias("at"))
    both = weights.join(added, ["session", "key"], "full_outer")
    return both.select("session", "key", F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0))) + F.coalesce("delta", F.lit(0))).alias("weight"), F.coalesce(F.col("ord"), F.lit(1000) + F.col("at")).alias("ord"))


def profile_weights(criteria: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """key, weight, ord of a profile's criteria (key, default_weight, ord), with weights (key, weight) where they are given; of many
    profiles, told apart by the columns `by` of both."""
    return criteria.join(weights, [*by, "key"], "left").select(*by, "key", F.coalesce("weight", "default_weight").alias("weight"), "ord")
