"""Scalars, lookups, registry, reviews, sources and streams on small inputs."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from decidra.functions import scalars as S
from decidra.operators import advisor, catalog, recommend, reviews
from decidra.sources import readers
from decidra.streaming import reviews as stream

NBSP, WIDE, BOM = chr(0xA0), chr(0x3000), chr(0xFEFF)


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("x", "y"), [("", 0.0), (" 12 ", 12.0), ("1d", None), ("0x10", 16.0), ("1.0", 1.0), ("x", None), (".5", 0.5), ("1e2", 100.0), (None, None)])
def test_to_number(spark, x, y):
    assert one(spark, x, "string", S.to_number) == y


@pytest.mark.parametrize(("x", "y"), [(2.5, 3), (-2.5, -2), (0.49999, 0)])
def test_rounding(spark, x, y):
    assert one(spark, x, "double", S.round_half_up) == y


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=30))
def test_clamp_is_idempotent(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(S.clamp(F.col("x")).alias("a")).withColumn("b", S.clamp(F.col("a")))
    assert all(r.a == r.b and 0 <= r.a <= 100 for r in df.collect())


def test_clamp_keeps_null_and_nan(spark):
    assert one(spark, None, "double", S.clamp) is None and one(spark, float("nan"), "double", S.clamp) != one(spark, float("nan"), "double", S.clamp)


def test_text(spark):
    assert one(spark, f"{BOM} a {NBSP}{WIDE} b\t", "string", S.collapse) == "a b"
    assert one(spark, f"{NBSP} ", "string", S.trim) == ""
    assert one(spark, "&amp;lt; x", "string", S.decoded) == "< x"
    assert one(spark, "https://Brand.Example.com:443/a/b/?x=1#h", "string", S.normalized_url) == "https://brand.example.com/a/b"
    assert one(spark, "https://m.shop.example.com/x", "string", lambda u: S.allowed_url(u, ["shop.example.com"])) is True
    assert one(spark, "https://m.shop.example.com/x", "string", lambda u: S.allowed_url(u, ["shop.example.com"], subdomains=False)) is False
    assert one(spark, "not a url", "string", S.is_web_url) is False
    assert one(spark, "a b&", "string", S.url_text) == "a%20b%26"
    assert one(spark, 1234567.891, "double", S.grouped) == "1,234,567.891"
    assert one(spark, 0.35, "double", S.fixed1) == 0.3 and one(spark, 40.0, "double", S.fixed1) == 40.0
    assert one(spark, "1.0", "string", S.positive_integer) == 1 and one(spark, "9007199254740993", "string", S.positive_integer) is None


@pytest.mark.parametrize(("x", "y"), [(None, 20), (0.0, 1), (7.9, 7), (500.0, 100)])
def test_requested_reviews(spark, x, y):
    assert one(spark, x, "double", S.requested_reviews) == y


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "100% wool", "a"), (2, "under_score", "b"), (3, None, "Plain")], "id long, name string, category string")
    ids = lambda q: sorted(r.id for r in catalog.search(df, q).collect())
    assert (ids("100%"), ids("_"), ids(""), ids(" PLAIN ")) == ([1], [2], [1, 2, 3], [3])


def test_lookups(spark):
    df = spark.range(5)
    assert catalog.single(df.filter("id = 3")).id == 3 and catalog.single(df.filter("id > 9"), required=False) is None
    for bad in (df, df.filter("id > 9")):
        with pytest.raises(ValueError):
            catalog.single(bad)
    assert catalog.by_ids(df, []).count() == 5 and catalog.pick(df, 3).first().id == 3 and catalog.pick(df, 99).first().id == 0
    assert one(spark, [1, 2], "array<int>", lambda a: catalog.toggled(a, F.lit(2))) == [1] and one(spark, [1], "array<int>", lambda a: catalog.toggled(a, F.lit(2))) == [1, 2]


def test_replaced_and_delete_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "id long, name string")
    got = catalog.replaced(rows, spark.createDataFrame([(1, None)], "id long, name string")).collect()
    assert sorted((r.id or 0, r.name) for r in got if r.id != 1) == [(0, "n"), (2, None)] and [r.name for r in got if r.id == 1] == [None]
    assert catalog.delete(rows, 1).count() == 2


def test_dedupe_by_key(spark):
    rows = [("p", k, x, t) for k, (x, t) in enumerate([("id1", "x"), ("id2", "x"), (None, "x"), (None, "x"), ("id1", "y"), ("id9", "  ")])]
    df = spark.createDataFrame(rows, "product string, pos0 int, cid string, content string")
    got = reviews.dedupe_by_key(df, "product", F.col("cid"), "content", ["pos0"])
    assert [(r.pos, r.content) for r in got.orderBy("pos").collect()] == [(1, "x"), (2, "x"), (3, "x")]


def test_review_source_and_stream(spark, tmp_path):
    def page(n, last, start):
        return {"contents": [{"contentsId": str(start + i), "reviewContent": f"text  {start + i}"} for i in range(n)], "last": last}

    for product, sizes in {"p1": (20, 20, 5), "p2": (3,)}.items():
        (tmp_path / "pages" / product).mkdir(parents=True)
        for k, n in enumerate(sizes):
            (tmp_path / "pages" / product / f"{k}.json").write_text(json.dumps(page(n, k == len(sizes) - 1, 20 * k)))
    count = lambda m: {r.product_id: r["count"] for r in readers.review_pages(spark, str(tmp_path / "pages"), m).groupBy("product_id").count().collect()}
    assert count(100) == {"p1": 45, "p2": 3} and count(20) == {"p1": 20, "p2": 3}

    for k in range(2):  # the second file repeats the first one's reviews
        at = tmp_path / "in" / "product=p1"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{k}.json").write_text(json.dumps(page(4 + k, True, 0)))
    found = stream.new_reviews(stream.page_stream(spark, str(tmp_path / "in"), 1))
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"text {i}" for i in range(5)]


def test_review_source_obeys_its_maximum(spark, tmp_path):
    def put(product, number, contents, **more):
        (tmp_path / product).mkdir(exist_ok=True)
        (tmp_path / product / f"{number}.json").write_text(json.dumps({"contents": contents, **more}))

    full = [{"contentsId": None, "reviewContent": f" text {k} "} for k in range(20)]
    put("over", 0, full)
    put("over", 1, full[:3] + [{"contentsId": f"i{k}", "reviewContent": f"more {k}"} for k in range(17)])
    put("bad", 0, full)
    put("bad", 1, [], status=500)
    put("enough", 0, full)
    put("enough", 1, [], status=500)
    put("odd", 0, "no list")
    read = lambda n: {r.product_id: r["count"] for r in readers.review_pages(spark, str(tmp_path), n).groupBy("product_id").count().collect()}
    assert read(25) == {"over": 25} and read(20) == {"over": 20, "bad": 20, "enough": 20} and read(100) == {"over": 37}


def test_collected(spark):
    full = [(None, f" text  {k} ") for k in range(20)]
    rows = [
        ("over", 0, None, None, full), ("over", 1, 200, None, full[:3] + [(f"i{k}", "more") for k in range(17)]), ("last", 0, None, True, full), ("last", 1, None, None, full), ("bad", 0, None, None, full),
        ("bad", 1, 500, None, full), ("odd", 0, None, None, None), ("later", 0, None, None, full[:5]), ("later", 1, 500, None, []), (None, 0, None, None, [("a", "x"), ("a", "y"), ("b", None), ("c", " ")]),
    ]
    pages = spark.createDataFrame(rows, "product string, page int, status int, last boolean, contents array<struct<id: string, content: string>>")
    count = lambda n: {r["product"]: r["count"] for r in reviews.collected(pages, n).groupBy("product").count().collect()}
    assert count(30) == {"over": 30, "last": 20, "later": 5, None: 1} and count(20) == {"over": 20, "last": 20, "bad": 20, "later": 5, None: 1}
    assert [r.content for r in reviews.collected(pages, 2).filter("product = 'last'").orderBy("pos").collect()] == ["text 0", "text 1"]
    assert reviews.collected(pages.limit(0)).count() == 0


def test_messages_and_sessions(spark):
    from decidra.functions import exchange as X

    said = spark.createDataFrame([("p", ["a", "b"]), ("q", []), ("r", None)], "p string, said array<string>")
    sent = {r.p: r.m for r in said.select("p", X.transfer_message("t", F.col("p"), F.col("said"), url=F.lit("u")).alias("m")).collect()}
    assert json.loads(sent["p"]) == {"type": "t", "productId": "p", "url": "u", "reviews": ["a", "b"]} and sent["q"] is None and sent["r"] is None
    other = json.dumps({"type": "t", "productId": "x", "reviews": ["z"]})
    rows = [("p", 2, sent["p"]), ("p", 1, "no json"), ("p", 3, sent["p"].replace("a", "c")), ("q", 1, other), ("q", 2, sent["p"]), ("r", 1, None)]
    got = reviews.first_messages(spark.createDataFrame(rows, "product string, at int, message string"), "t").collect()
    assert {r["product"]: (r["at"], r.reviews) for r in got} == {"p": (2, ["a", "b"]), "q": (1, None)}
    weights = lambda t: one(spark, t, "string", X.number_weights)
    assert weights('{"a": 3, "b": "4", "c": 12.5, "d": -1, "e": null, "f": true, "g": [1]}') == {"a": 3.0, "c": 10.0, "d": 0.0}
    assert weights(None) == weights("x") == weights("[1]") == weights("{}") == {}


def test_refused_pages(spark):
    from decidra.operators import pages

    df = spark.createDataFrame([(1, "ok", 200), (2, "ok", 418), (3, "Access Denied", 200), (4, "ok", None), (5, None, 404)], "page_id int, html string, status int")
    assert [r.b for r in df.select("page_id", pages.refused(F.col("html"), F.col("status")).alias("b")).orderBy("page_id").collect()] == [False, True, True, False, True]


def test_static_products(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"id": 1, "name": "가", "price": 5, "cons": ["x"], "isDiscontinued": False}, {"id": 2}], indent=1))
    got = readers.static_products(spark, str(tmp_path / "p.json")).orderBy("id").collect()
    assert got[0].price == 5.0 and got[0].cons == ["x"] and got[1].name is None
    assert readers.market_search(spark, "x").count() == 0


def test_analysis(spark):
    df = spark.createDataFrame([("p", k, f"review {k}") for k in range(250)], "product string, pos int, review string")
    body = json.loads(reviews.analyze(df).first().analysis)
    assert body["reviewCount"] == 200 and body["confidenceScore"] == 100


def test_exchange(spark):
    from decidra.functions import exchange as X

    assert one(spark, "https://a.b/c?x=1&y=%20z&x=2&flag#q", "string", X.parameters) == {"x": "1", "y": " z", "flag": ""}
    assert one(spark, "/p", "string", lambda c: X.link("/q", ids=F.lit("1,2 3"), none=F.lit(None).cast("string"))) == "/q?ids=1%2C2%203"
    assert one(spark, "x", "string", lambda c: X.link("/q")) == "/q"
    body = lambda t: one(spark, t, "string", lambda c: F.to_json(X.captured_body(c)))
    assert json.loads(body('{"a": 1}')) == {"a": 1} and json.loads(body("a=1&b=x+y")) == {"a": "1", "b": "x y"} and body("nothing") is None
    message = {"type": "reviews", "productId": "p1", "reviews": [" a  b ", "a b", 3, "", "c"]}
    read = lambda m, tag="reviews", p="p1": one(spark, json.dumps(m), "string", lambda c: X.transfer(c, tag, F.lit(p)))
    assert read(message) == ["a b", "c"] and read(message, tag="other") is None and read(message, p="p2") is None and read(message | {"reviews": 1}) == []
    assert X.selection([1, 2]) == [1, 2]
    with pytest.raises(ValueError):
        X.selection([1])
    assert one(spark, ["x", "y"], "array<string>", lambda r: X.review_prompt(F.lit("P"), F.lit("C"), r, ["noise"])).endswith("1. x\n2. y")
    df = spark.createDataFrame([("ask",), (" ",), (None,)], "p string").select(X.answered(F.col("p"), str.upper).alias("a"))
    assert sorted(r.a or "" for r in df.collect()) == ["", "", "ASK"]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("wide", [False, True])
def test_rank_all_over_many_rows(spark, adaptive, wide):
    n, before = 1_000_000, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.range(n).selectExpr("id", "cast(id * 7919 % 1000 as double) as score", *(["repeat(cast(id as string), 20) as more"] if wide else []))
        got = recommend.rank_all(df, F.col("score"))
        seen = got.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("k"), F.min("rank").alias("a"), F.max("rank").alias("b")).first()
        assert tuple(seen) == (n, n, 1, n)
        # neighbours are in order
        far = got.filter("rank in (1, 2, 1000, 1001, 999999, 1000000)").orderBy("rank").select("score", "id").collect()
        assert far == sorted(far, key=lambda r: (-r.score, r.id)) and far[0].score == 999
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_registry_clashes(spark):
    kinds = "id long, name string, origin_product_no long, source_url string"
    old = spark.createDataFrame([(1, "a", 10, "u1"), (2, "b", None, "u2"), (3, "c", 30, None)], kinds)
    new = spark.createDataFrame([(4, "d", 10, "u9"), (5, "e", 50, "u2"), (6, "f", 60, "u6"), (7, "g", 60, "u7"), (8, "h", None, None)], kinds)
    assert sorted(r.id for r in catalog.insert_new(old, new).collect()) == [1, 2, 3, 6, 8]
    got = {r.id: tuple(r)[1:] for r in catalog.register(old, new).collect()}
    assert got == {1: ("d", 10, "u9"), 2: ("e", 50, "u2"), 3: ("c", 30, None), 6: ("f", 60, "u6"), 8: ("h", None, None)}


def test_a_missing_confidence_counts_as_zero(spark):
    df = spark.createDataFrame([(1, 90.0, None), (2, 90.0, 80.0), (3, 90.0, float("nan"))], "id long, noise double, confidence_score double").withColumn("review_analysis", F.lit("{}"))
    got = {r.id: r.confidence for r in advisor.advise(df, {"noise": 8.0}, {"noise": F.col("noise")}, F.col("confidence_score")).collect()}
    assert got == {1: 70, 2: 94, 3: None}


def test_answers_of_odd_analyses(spark):
    rows = [
        (1, "c", "{}", 80.0), (2, "c", "no json", 70.0), (3, "c", '{"confidenceScore": "x", "summary": null, "bestFor": "all"}', 60.0), (4, "c", None, 99.0),
        (5, "c", '{"confidenceScore": "50", "summary": "s", "reviewCount": true, "criterionReasons": {"noise": 3}, "criterion_reasons": {"noise": "old"}}', 50.0), (6, "d", "{}", 90.0), (7, "c", "{}", None),
        (8, "c", '{"criterionReasons": null, "criterion_reasons": {"noise": "old"}, "cautions": ["a", "a", "b"]}', 40.0),
    ]
    df = spark.createDataFrame(rows, "id long, category string, review_analysis string, score double")
    got = {r.id: r for r in advisor.answers(df, {"noise": 2.0, "value": 0.0}, {"noise": F.col("score")}, "c").collect()}
    assert {k: r["rank"] for k, r in got.items()} == {1: 1, 2: 2, 3: 3, 5: 4, 8: 5}
    assert [got[k].confidence for k in (1, 2, 3, 5)] == [70, 70, None, 85] and [got[k].review_count for k in (1, 5)] == [0.0, 1.0]
    assert got[5].summary == "s" and len({got[k].summary for k in (1, 2, 3)}) == 1 and got[3].best_for == []
    assert got[8].criteria[0].reason == "old" and got[5].criteria[0].reason == got[1].criteria[0].reason != "old"
    assert got[8].cautions[:1] == ["a"] and len(got[8].cautions) == 2


def test_an_analysis_is_parsed_once(spark, sf):
    from decidra.plans import catalogue

    plan = catalogue.queries()["normalize_scores"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("get_json_object") == len(catalogue.ANALYSES)


def test_scores_of_odd_analyses(spark):
    f = "`" * 3
    texts = {
        None: {}, "": {}, "[]": {}, "null": {}, '{"criterionScores": null}': {}, '{"criterionScores": "5", "criterionReasons": [1]}': {}, '{"criterionScores": {"noise": 1, "noise": 2}}': {}, f"{f}{f}": {},
        '{"criterionScores": {"noise": 49.5, "Noise": 3, "drainage": -0.4, "value": 1e300}}': {"noise": 50.0, "drainage": 0.0, "value": 100.0},
        f'{f}JSON{WIDE}\n{{"criterionScores": {{"noise": " 7.5{NBSP}", "value": "", "drainage": "0x1F", "portability": "1e999", "installation": "7 7"}}}}\n {f}': {"noise": 8.0, "value": 0.0, "drainage": 31.0, "portability": 100.0},
        f'{f}\t{{"criterionScores": {{"noise": true, "value": false, "drainage": [1], "portability": {{}}}}, "criterionReasons": {{"noise": "{BOM} a  b{WIDE}", "value": 3}}}}{f}': {"noise": 1.0, "value": 0.0},
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, analysis string")
    found = {}
    for r in reviews.normalized(rows).collect():
        found.setdefault(r.id, {})[r.key] = (r.score, r.reason)
    assert len(found) == len(texts) and all(list(own) == list(reviews.CRITERION_LABELS) for own in found.values())
    assert [{k: s for k, (s, _) in found[i].items() if s is not None} for i in range(len(texts))] == list(texts.values())
    assert {(i, k): t for i, own in found.items() for k, (_, t) in own.items() if t != reviews.NO_EVIDENCE} == {(len(texts) - 1, "noise"): "a  b"}


@pytest.mark.parametrize("text", [None, "", " ", "a", f" a{WIDE}b \t", f"{BOM}{NBSP} é ", "\u200b x\x1c", "\x0b\x0c\r\n한 글   ", "😀 "])
def test_trim_takes_white_space_of_the_ends(spark, text):
    import re

    assert one(spark, text, "string", S.trim) == (text if text is None else re.sub(rf"\A[{S.WS}]+|[{S.WS}]+\Z", "", text))
