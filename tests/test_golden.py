"""Worked examples: five demo products, advisor rows, answers."""

import pytest
from pyspark.sql import functions as F

from decidra.functions import scalars as S
from decidra.operators import advisor, recommend

# id, price, cooling, quietness, portability, battery, after-sales, review, count, popularity, brand, sales, availability, recency
ROWS = [
    (1, 499000, 95, 82, 78, 72, 88, 88, 824, 84, 82, 80, 91, 88), (2, 329000, 79, 86, 91, 62, 72, 81, 516, 75, 70, 78, 89, 82), (3, 1290000, 93, 90, 70, 98, 91, 92, 1942, 94, 93, 92, 86, 80),
    (4, 1190000, 86, 84, 99, 90, 78, 86, 731, 87, 81, 84, 77, 76), (5, 450000, 83, 76, 82, 58, 76, 78, 288, 67, 68, 65, 81, 74),
]
NAMES = ["cooling", "quietness", "portability", "battery", "after_service", "review_score", "review_count", "popularity_score", "brand_trust_score", "sales_rank_score", "availability_score", "recency_score"]


@pytest.fixture(scope="module")
def products(spark):
    kinds = ", ".join(f"{n} {'long' if n == 'review_count' else 'double'}" for n in ["price", *NAMES])
    rows = [(r[0], *(x if n == "review_count" else float(x) for n, x in zip(["price", *NAMES], r[1:], strict=True)), "에어컨", False) for r in ROWS]
    return spark.createDataFrame(rows, f"id long, {kinds}, category string, is_discontinued boolean")


@pytest.mark.parametrize(("budget", "weights", "expected"), [
    (500000, (5, 4, 4, 3, 3), [(1, 87.2), (2, 83.1), (5, 80.7), (3, 72.6), (4, 71.7)]), (0, (3, 3, 3, 3, 3), [(3, 90.8), (4, 89.5), (1, 86.6), (2, 82.3), (5, 79.8)]),
    (500000, (0, 0, 0, 0, 0), [(1, 26.8), (2, 26.1), (5, 25.8), (3, 9.2), (4, 8.6)]), (-1, (1, 0, 0, 0, 0), [(1, 95.2), (3, 94.2), (4, 88.5), (5, 85.6), (2, 83.0)]),
    (330000, (1, 5, 5, 1, 1), [(2, 86.9), (1, 74.2), (5, 73.7), (4, 73.3), (3, 69.1)]),
])
def test_recommendation(products, budget, weights, expected):
    w = dict(zip(NAMES[:5], map(float, weights), strict=True))
    assert [(r.id, r.score) for r in recommend.recommend(products, budget, w).collect()] == expected


def test_recommendation_texts(products):
    w = dict(zip(NAMES[:5], (5.0, 4.0, 4.0, 3.0, 3.0), strict=True))
    got = {r.id: r for r in products.select("id", recommend.reasons(500000, w).alias("why"), recommend.cautions(500000, F.array().cast("array<string>")).alias("but")).collect()}
    assert [x.split(" 점수")[0] for x in got[3].why] == ["냉방 성능", "저소음", "배터리"] and got[3].but == ["예산보다 790,000원 높습니다."]
    assert got[1].why[0] == "설정한 예산 범위에 들어옵니다." and got[1].but == []
    below = products.select("id", recommend.cautions(-1, F.array().cast("array<string>")).alias("but")).first()
    assert len(below.but) == 1  # a negative budget costs no points, but is exceeded


def test_market(products):
    top = recommend.market_top(products).collect()
    assert [(r.id, r.market_score, r["rank"]) for r in top] == [(3, 93.7, 1), (1, 73.2, 2), (4, 72.4, 3), (2, 64.8, 4), (5, 56.0, 5)]
    assert [top[0][f"part_{p}"] for p in ("sales", "review_count_part", "rating", "brand_trust", "interest", "recency")] == [27.6, 25.0, 18.4, 9.3, 9.4, 4.0]
    said = {r.id: len(r.m) for r in products.select("id", recommend.market_reasons().alias("m")).collect()}
    assert said == {1: 4, 2: 2, 3: 6, 4: 2, 5: 1}


ADVISED = [("A", '{"noise": 90, "portability": 60, "value": 70}', 80.0), ("B", '{"noise": 95, "portability": null, "value": "70"}', 90.0), ("C", '{"noise": 101, "drainage": 99}', 99.0), ("D", '{"noise": 75, "portability": 85, "value": 90}', 140.0), ("E", '{"noise": 79, "portability": 79, "value": 79}', 0.0)]


def _advised(spark, weights):
    df = spark.createDataFrame([(*r, "{}", "x") for r in ADVISED], "id string, scores string, confidence_score double, review_analysis string, category string")
    v = F.try_parse_json("scores")
    scores = {k: S.json_number(F.try_variant_get(v, f"$.{k}", "variant")) for k in ("noise", "portability", "value", "drainage")}
    return [(r.id, r.match_score, r.coverage, r.confidence) for r in advisor.advise(df, weights, scores, F.col("confidence_score")).orderBy("rank").collect()]


def test_advisor(spark):
    assert _advised(spark, {"noise": 8, "portability": 5, "value": 2, "drainage": 0}) == [("B", 95, 53, 64), ("D", 80, 100, 100), ("E", 79, 100, 70), ("A", 77, 100, 94)]
    assert ("A", 90, 50, 59) in _advised(spark, {"noise": 0.5})
    with pytest.raises(ValueError):
        advisor.active({"noise": 0})


def test_weights(spark):
    start = spark.createDataFrame([("s", "cooling_capacity", 9.0, 0), ("s", "noise", 9.0, 1)], "session string, key string, weight double, ord int")
    answers = {"people": "5_plus", "space": "car", "power": "inverter", "budget": "under_500", "sleep_use": "true", "frequent_move": "true"}
    got = advisor.adjusted_weights(start, spark.createDataFrame([("s", k, v) for k, v in answers.items()], "session string, question string, answer string")).orderBy("ord").collect()
    assert [(r.key, r.weight) for r in got] == [("cooling_capacity", 10), ("noise", 10), ("power_consumption", 2), ("portability", 3), ("installation", 2), ("power_compatibility", 2), ("value", 2)]
    assert advisor.clean_weights({"a": "5", "b": None, "c": "x", "d": 12, "e": -1}) == {"a": 5, "b": 0, "d": 10, "e": 0}
    assert advisor.clean_weights("none") == {}
