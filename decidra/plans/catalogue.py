"""All queries of the product decision engine by name, and SQL for DuckDB that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import exchange as X
from decidra.functions import scalars as S
from decidra.operators import advisor, catalog, pages, recommend, reviews
from decidra.schemas import FIVE_CRITERIA, GOOD_SCORE, LOW_SCORE, NO_REASON_STORED, NO_SUMMARY
from decidra.sources.readers import product_facts, table
from decidra.sources.scratch import new_path, written
from decidra.streaming.reviews import distinct_events

BUDGET = 910.0
WEIGHTS = {"cooling": 5.0, "quietness": 4.0, "portability": 4.0, "battery": 3.0, "after_service": 3.0}
EQUAL = dict.fromkeys(WEIGHTS, 3.0)
#: Advisor weights, one of them for a criterion without scores.
ADVISOR = {"noise": 8.0, "portability": 5.0, "cooling_capacity": 4.0, "value": 3.0, "power_consumption": 2.0, "durability_service": 1.0, "drainage": 0.0}
#: The advisor's criteria over product facts; a score is unknown where (id + place) is a multiple of 7.
SCORED = {"noise": "quietness", "portability": "portability", "cooling_capacity": "cooling", "power_consumption": "battery", "durability_service": "after_service"}
CATEGORY = "SMALL"
ONE_CATEGORY = "PROMO"

# --- shared SQL -------------------------------------------------------------------------------------------------------

_pct = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*)"
PF = f"""s AS (SELECT l_partkey, count(*) AS review_count, {_pct("l_quantity >= 25")} AS cooling, {_pct("l_tax < 0.04::DOUBLE")} AS quietness, {_pct("l_discount < 0.05::DOUBLE")} AS battery,
  {_pct("l_linestatus = 'F'")} AS after_service, {_pct("l_returnflag <> 'R'")} AS review_score, {_pct("l_linenumber <= 3")} AS popularity_score, {_pct("l_returnflag = 'N'")} AS availability_score,
  {_pct("l_shipdate >= TIMESTAMP '1997-01-01'")} AS recency_score, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at FROM lineitem GROUP BY l_partkey),
pf AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS price, p_size::DOUBLE AS weight_kg, (100 - 2 * p_size)::DOUBLE AS portability,
  substr(p_brand, 7)::DOUBLE * 4 AS brand_trust_score, p_partkey % 17 = 0 AS is_discontinued, s.* EXCLUDE (l_partkey), least(100, review_count * 2)::DOUBLE AS sales_rank_score,
  p_partkey % 5 <> 0 AS analyzed, CASE WHEN p_partkey % 5 <> 0 THEN review_count * 2 END AS confidence FROM part JOIN s ON p_partkey = l_partkey)"""
_RX = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_collapse = lambda x: f"trim(regexp_replace({x}, '{_RX}+', ' ', 'g'))"
_trim = lambda x: f"regexp_replace({x}, '^{_RX}+|{_RX}+$', '', 'g')"


def _decode(x: str) -> str:
    for name, char in S.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return _trim(x)


def _score_sql(budget: float, weights: dict[str, float]) -> str:
    total = sum(weights.values()) or 1
    fit = "(0.0::DOUBLE" + "".join(f" + {c} * {w}::DOUBLE" for c, w in weights.items()) + f") / {total}::DOUBLE * 0.72::DOUBLE"
    price = f"CASE WHEN price > {budget} THEN greatest(0.0::DOUBLE, 100.0::DOUBLE - ((price - {budget}::DOUBLE) / {budget}::DOUBLE) * 120.0::DOUBLE) ELSE 100.0::DOUBLE END" if budget > 0 else "100.0::DOUBLE"
    return f"floor(({fit} + ({price}) * 0.18::DOUBLE + review_score * 0.1::DOUBLE) * 10 + 0.5::DOUBLE) / 10"


_clamp = lambda x: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"
_MARKET = {
    "sales": f"{_clamp('sales_rank_score')} * 0.3::DOUBLE", "review_count_part": f"{_clamp('least(100.0::DOUBLE, review_count / most * 100)')} * 0.25::DOUBLE", "rating": f"{_clamp('review_score')} * 0.2::DOUBLE",
    "brand_trust": f"{_clamp('brand_trust_score')} * 0.1::DOUBLE", "interest": f"{_clamp('popularity_score')} * 0.1::DOUBLE", "recency": f"{_clamp('recency_score')} * 0.05::DOUBLE",
}
_round1 = lambda x: f"floor(({x}) * 10 + 0.5::DOUBLE) / 10"


def _market_sql(by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    parts = ", ".join(f"{_round1(p)} AS part_{n}" for n, p in _MARKET.items())
    return f"""WITH {PF}, e AS (SELECT *, greatest(1, max(review_count) OVER ({over})) AS most FROM pf WHERE NOT is_discontinued AND availability_score >= 30),
m AS (SELECT *, {_round1(" + ".join(_MARKET.values()))} AS market_score, {parts} FROM e)"""


_MARKET_ORDER = "market_score DESC, availability_score DESC, review_count DESC, id"
_scores_sql = {key: f"(CASE WHEN (id + {k}) % 7 = 0 THEN NULL ELSE {column} END)" for k, (key, column) in enumerate(SCORED.items(), 1)}
_active = {k: w for k, w in ADVISOR.items() if w > 0}


def _advisor_sql() -> str:
    total = "0.0::DOUBLE" + "".join(f" + coalesce({_scores_sql[k]} * {w}::DOUBLE, 0.0)" for k, w in _active.items() if k in SCORED)
    used = "0.0::DOUBLE" + "".join(f" + CASE WHEN {_scores_sql[k]} IS NULL THEN 0.0 ELSE {w}::DOUBLE END" for k, w in _active.items() if k in SCORED)
    return f"""WITH {PF}, u AS (SELECT *, {total} AS t, {used} AS used FROM pf WHERE analyzed),
a AS (SELECT *, floor(t / used + 0.5::DOUBLE)::BIGINT AS match_score, floor(used / {sum(_active.values())}::DOUBLE * 100 + 0.5::DOUBLE)::BIGINT AS coverage FROM u WHERE used > 0),
m AS (SELECT *, floor(coverage * 0.7::DOUBLE + {_clamp("confidence::DOUBLE")} * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT AS sure FROM a)"""


def _items_sql() -> str:
    """A row per product and active criterion: id, ord, key, label, score, weight."""
    from decidra.schemas import CRITERION_LABELS as L

    rows = " UNION ALL ".join(f"SELECT id, {k} AS ord, '{key}' AS key, '{L.get(key, key)}' AS label, {_scores_sql.get(key, 'NULL::DOUBLE')} AS score, {w}::DOUBLE AS weight FROM pf WHERE analyzed" for k, (key, w) in enumerate(_active.items()))
    return f"WITH {PF}, i AS ({rows})"


# --- queries ----------------------------------------------------------------------------------------------------------


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Product facts with a stand-in for the stored analysis."""
    known = F.col("id") % 5 != 0
    return product_facts(spark, d).withColumns({"review_analysis": F.when(known, F.lit("{}")), "confidence": F.when(known, F.col("review_count") * 2)})


def scores() -> dict[str, F.Column]:
    return {key: F.when((F.col("id") + k) % 7 != 0, F.col(column)) for k, (key, column) in enumerate(SCORED.items(), 1)}


def _recommended(budget: float, weights: dict[str, float]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        scored = product_facts(spark, d).withColumn("score", S.round1(recommend.score(budget, weights)))
        return recommend.rank_all(scored.select("id", "score"), F.col("score"))

    return run


def recommend_rank_lineitem(spark, d):
    """All line items by price: a full ranking of the largest table."""
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price"))
    return recommend.rank_all(own, F.col("price"))


def filled(texts: list[str | None], at: F.Column, value: F.Column) -> F.Column:
    """The text whose number is `at` modulo their number, with the value in place of %k."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        if text is not None:
            out = F.when(at % len(texts) == k, F.replace(F.lit(text), F.lit("%k"), value.cast("string"))).otherwise(out)
    return out


def _exploded(df: DataFrame, items: F.Column, name: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(items).alias("pos", name)).withColumn("pos", F.col("pos") + 1)


def recommend_reasons(spark, d):
    return _exploded(product_facts(spark, d), recommend.reasons(BUDGET, WEIGHTS), "reason", "id")


def recommend_cautions(spark, d):
    return _exploded(product_facts(spark, d), recommend.cautions(BUDGET, F.array("name", "brand", "category")), "caution", "id")


def _market_facts(spark, d) -> DataFrame:
    """What the market scores read, written once: the greatest review count needs all rows before any is scored, and line items
    would be read and summed twice."""
    columns = ["id", "category", "is_discontinued", "availability_score", "sales_rank_score", "review_count", "review_score", "brand_trust_score", "popularity_score", "recency_score"]
    return written(product_facts(spark, d).select(columns), "market")


def market_top5(spark, d):
    return recommend.market_top(_market_facts(spark, d)).select("id", "market_score", "rank")


def market_top5_per_category(spark, d):
    return recommend.market_top_by_category(_market_facts(spark, d)).select("category", "id", "market_score", "rank")


def market_breakdown(spark, d):
    return recommend.market_scored(_market_facts(spark, d)).select("id", "market_score", *(f"part_{p}" for p in _MARKET))


def market_reasons(spark, d):
    return _exploded(recommend.market_scored(_market_facts(spark, d)), recommend.market_reasons(), "reason", "id")


def catalog_search(spark, d):
    return catalog.search(facts(spark, d), " SMALL ", analyzed_only=True).select("id", "name", "category")


def _sorted(kind: str):
    def run(spark, d):
        order = catalog.sort_order(kind)
        return recommend.with_rank(catalog.page(facts(spark, d), kind), *order).select("id", "rank")

    return run


# Hangul before Latin, as Korean collation has it
NAMES = ["브리즈 캠핑 에어컨", "카투어 이동식 에어컨", "Zeta Cooler", "arctic mini", "가온 냉풍기", "Arctic Max", "하늘 선풍기", "나래 에어컨"]


def catalog_sort_name_ko(spark, d):
    """The products of each order by their Korean or English names."""
    stem = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("l_partkey") % len(NAMES) + 1).cast("int"))
    own = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.concat_ws(" ", stem, F.expr("l_partkey div 3")).alias("name"))
    return recommend.with_rank(own, *catalog.sort_order("name"), by=("l_orderkey",)).select("l_orderkey", "name", "rank")


def analyzed_count(spark, d):
    return facts(spark, d).agg(F.count_if(F.col("review_analysis").isNotNull()).alias("n"))


def products_by_ids(spark, d):
    wanted = spark.range(1).select(F.explode(S.truthy_ids(F.lit("1,x,0,3, 7 ,1e2"))).alias("w")).collect()
    return catalog.by_ids(product_facts(spark, d), [int(r["w"]) for r in wanted]).select("id", "name")


def product_pick(spark, d):
    return catalog.pick(product_facts(spark, d), -1).select("id", "name")


def advisor_match(spark, d):
    best = advisor.advise(facts(spark, d).filter(F.col("category").contains(CATEGORY)), ADVISOR, scores(), F.col("confidence").cast("double"))
    return best.select("id", "match_score", "coverage", F.col("confidence").alias("sure"), "rank")


def advisor_match_per_category(spark, d):
    best = advisor.advise_all(facts(spark, d), ADVISOR, scores(), F.col("confidence").cast("double"))
    return best.select("category", "id", "match_score", "coverage", F.col("confidence").alias("sure"), "rank")


def advisor_match_long(spark, d):
    """The same match and coverage for weights that are a table."""
    own = facts(spark, d).filter(F.col("review_analysis").isNotNull())
    unpivoted = own.select("id", F.explode(F.create_map(*(x for k, c in scores().items() for x in (F.lit(k), c)))).alias("key", "score"))
    return advisor.advise_long(unpivoted, spark.createDataFrame([(key, w, k) for k, (key, w) in enumerate(_active.items())], "key string, weight double, ord int"))


def _with_items(spark, d) -> DataFrame:
    return facts(spark, d).filter(F.col("review_analysis").isNotNull()).withColumn("items", advisor.breakdown(_active, scores()))


def advisor_breakdown(spark, d):
    return _exploded(_with_items(spark, d), F.col("items"), "i", "id").select("id", "pos", "i.key", "i.label", "i.score", "i.weight", "i.contribution")


def advisor_strongest3(spark, d):
    return _exploded(_with_items(spark, d), advisor.strongest(F.col("items")), "i", "id").select("id", "pos", "i.key")


def advisor_weakest2(spark, d):
    return _exploded(_with_items(spark, d), advisor.weakest(F.col("items")), "i", "id").select("id", "pos", "i.key")


def advisor_winner_top4(spark, d):
    """The four heaviest criteria of the best product."""
    best = advisor.advise(_with_items(spark, d).filter(F.col("category").contains(CATEGORY)), ADVISOR, scores(), F.col("confidence").cast("double"), k=1)
    return _exploded(best, advisor.heaviest(F.col("items")), "i", "id").select("id", "pos", "i.key", "i.weight")


#: What a stored analysis says besides numbers; its reasons are under their older name.
SAID = '"cautions": [" loud ", "", 4], "negativePoints": [{"topic": "size", "summary": "too big"}], "bestFor": ["car ", "tent", "van", "home"], "criterion_reasons": {"noise": "quiet", "value": 3}'


def advisor_answers(spark, d):
    """All that is shown with the best products, lists joined."""
    summary = F.when(F.col("id") % 2 == 0, F.concat(F.lit('"about '), "id", F.lit('"'))).otherwise("null")
    text = F.concat(F.lit('{"confidenceScore": "'), "confidence", F.lit('", "reviewCount": '), "review_count", F.lit(', "summary": '), summary, F.lit(f", {SAID}}}"))
    best = advisor.answers(facts(spark, d).filter(F.col("category").contains(CATEGORY)).withColumn("review_analysis", text), ADVISOR, scores())
    joined = lambda name: F.array_join(name, "|").alias(name)
    criteria = F.array_join(F.transform("criteria", lambda i: F.concat_ws("=", i["key"], i["reason"])), "|").alias("criteria")
    return best.select("id", "rank", "match_score", "coverage", F.col("confidence").alias("sure"), "review_count", "summary", joined("reasons"), joined("cautions"), joined("best_for"), criteria)


def advisor_match_in_category(spark, d):
    best = advisor.advise(facts(spark, d), ADVISOR, scores(), F.col("confidence").cast("double"), category=ONE_CATEGORY)
    return best.select("id", "match_score", "coverage", F.col("confidence").alias("sure"), "rank")


def advisor_reasons(spark, d):
    return _exploded(_with_items(spark, d), advisor.reason_texts(F.col("items")), "reason", "id")


def catalog_search_brand(spark, d):
    return catalog.search(facts(spark, d), "brand#1", columns=("name", "category", "brand")).select("id", "brand")


def product_links(spark, d):
    """A link to each product's answers, without what is unknown."""
    own = facts(spark, d)
    return own.select("id", X.link("/advisor", category=F.col("category"), confidence=F.col("confidence").cast("string")).alias("link"))


def review_requests(spark, d):
    """How many reviews are asked for, on how many pages, and which products are ready for it."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 3 - 20).alias("asked"), (F.col("p_partkey") % 3).alias("checkout_merchant_no"), F.when(F.col("p_size") > 9, F.col("p_size")).alias("origin_product_no"))
    own = own.withColumn("requested", S.requested_reviews(F.col("asked").cast("double")))
    return own.select("id", F.col("requested").cast("int").alias("requested"), S.page_count(F.col("requested")).cast("int").alias("pages"), catalog.collection_ready().alias("ready"))


#: Cautions and negative points as stored (JSON text) by id; %k stands for it.
CAUTIONS = ['[" loud at night %k ", "", 3, null, "loud at night %k", "heavy"]', '"no list %k"', "[]", '["heavy", "heavy"]']
NEGATIVES = ['[{"topic": "size", "summary": "too big"}, {"topic": "cord"}]', '[{"summary": "heavy"}, {}, null, {"topic": "", "summary": ""}, {"topic": "weight", "summary": "%k"}]', "{}"]


def advisor_cautions(spark, d):
    """What speaks against each product: stored cautions and points, then its weakest criteria."""
    two = {key: c for key, c in scores().items() if key in ("noise", "portability")}
    items = advisor.breakdown({"noise": 8.0, "portability": 5.0}, two)
    stored = lambda texts: F.try_parse_json(filled(texts, F.col("id"), F.col("id")))
    said = advisor.caution_texts(items, S.json_texts(stored(CAUTIONS), 2), S.json_points(stored(NEGATIVES), 2))
    return _exploded(facts(spark, d), said, "caution", "id")


#: What customers answer: an answer by (c_custkey div the number) modulo their number.
ANSWERS = {"people": (1, ["1_2", "3_4", "5_plus"]), "space": (3, ["car", "large_tent", "caravan", "house"]), "power": (12, ["power_station", "inverter", "not_sure", "grid"]), "budget": (5, ["under_300", "under_500", "under_800", "any"]), "sleep_use": (2, ["true", "false"]), "frequent_move": (7, ["false", "true"])}


def _sessions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Weights that customers start with (one of them for two customers in three), and their answers."""
    own = table(spark, d, "customer")
    start = F.array(F.struct(F.lit("noise").alias("key"), (F.col("c_nationkey") / 2).alias("weight"), F.lit(0).alias("ord")), F.struct(F.lit("value").alias("key"), (F.col("c_acctbal") / 1000).alias("weight"), F.lit(1).alias("ord")))
    begun = own.select(F.col("c_custkey").alias("session"), F.explode(F.slice(start, 1, F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2))).alias("s")).select("session", "s.*")
    said = [F.struct(F.lit(q).alias("question"), F.element_at(F.array(*map(F.lit, a)), (F.expr(f"c_custkey div {n}") % len(a) + 1).cast("int")).alias("answer")) for q, (n, a) in ANSWERS.items()]
    return begun, own.select(F.col("c_custkey").alias("session"), F.inline(F.array(*said)))


def weights_adjusted(spark, d):
    return advisor.adjusted_weights(*_sessions(spark, d))


def weights_top4(spark, d):
    return recommend.with_rank(weights_adjusted(spark, d), F.desc("weight"), F.col("ord"), by=("session",)).filter("rank <= 4").select("session", "key", "rank")


CRITERIA = [("noise", 5.0, 0), ("value", 7.0, 1), ("portability", 7.0, 2), ("drainage", 2.0, 3)]


def analysis_join_weights(spark, d):
    """The three heaviest criteria of each customer's profile, with own weights where the customer has them."""
    own = table(spark, d, "customer")
    criteria = own.select("c_custkey", F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(w).alias("default_weight"), F.lit(at).alias("ord")) for k, w, at in CRITERIA))))
    weights = F.create_map(F.lit("noise"), F.col("c_acctbal") / 1000, F.lit("drainage"), F.col("c_nationkey").cast("double"), F.lit("unasked"), F.lit(9.0))
    kept = own.filter("c_custkey % 3 > 0").select("c_custkey", F.explode(weights).alias("key", "weight"))
    found = advisor.profile_weights(criteria, kept, by=("c_custkey",))
    return recommend.with_rank(found, F.desc("weight"), F.col("ord"), by=("c_custkey",)).filter("rank <= 3").select("c_custkey", "key", "weight", "rank")


def reviews_clean_dedupe(spark, d):
    return _exploded(table(spark, d, "documents"), F.array_distinct(reviews.review_lines(F.col("text"))), "review", "doc_id")


def reviews_cap100(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(reviews.distinct_reviews(F.col("text"))).alias("n"))


def reviews_dedupe_by_key(spark, d):
    turns = table(spark, d, "conversations").filter("role = 'user'")
    key = F.when(F.col("turn") % 4 == 0, F.lit("first"))
    return reviews.dedupe_by_key(turns, "conv_id", key, "text", ["turn"], most=100).select("conv_id", "pos", "turn", "text")


def review_messages_once(spark, d):
    """The first message with reviews of each conversation, the turn being its time; the rest is processed no more."""
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("product"), F.col("turn").alias("at"), reviews.distinct_reviews(F.col("text")).alias("said"))
    about = F.when(F.col("product") % 10 == 3, F.lit("another")).otherwise(F.col("product").cast("string"))
    message = X.transfer_message(F.when(F.col("at") == 0, F.lit("other")).otherwise(F.lit("reviews")), about, F.col("said"), sourceUrl=F.lit("https://shop.example.com/1"))
    first = reviews.first_messages(own.select("product", "at", message.alias("message")).filter("message is not null"), "reviews")
    return first.select(F.col("product").alias("conv_id"), F.col("at").alias("turn"), F.size("reviews").alias("n"), F.md5(F.array_join("reviews", "\n")).alias("digest"))


def review_collection(spark, d):
    """Lines of documents as pages of 20 reviews, at most 25 of which are collected; some second pages fail."""
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), ((F.size(lines) - 1) / 20).cast("int")), lambda p: F.slice(lines, p * 20 + 1, 20))
    each = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("product"), F.posexplode(cut).alias("page", "own"))
    review = lambda r: F.struct(F.when(F.length(r) % 7 == 0, F.concat(F.lit("n"), F.length(r))).alias("id"), r.alias("content"))
    status = F.when((F.col("product") % 11 == 0) & (F.col("page") == 1), 500)
    feed = each.select("product", "page", status.alias("status"), F.lit(None).cast("boolean").alias("last"), F.transform("own", review).alias("contents"))
    return reviews.collected(feed, 25).select(F.col("product").alias("doc_id"), "pos", "content")


def session_weights(spark, d):
    """Weights as a session keeps them, read back: numbers alone, within 0 to 10."""
    weights = F.create_map(F.lit("noise"), F.col("c_acctbal") / 500, F.lit("value"), F.col("c_nationkey").cast("double"))
    own = table(spark, d, "customer").select("c_custkey", X.session_text(F.col("c_mktsegment"), F.lit(None).cast("string"), F.create_map(F.lit("people"), F.lit("3_4")), weights).alias("t"))
    return own.select("c_custkey", F.explode(X.number_weights(F.col("t"), "$.weights")).alias("key", "weight"))


def event_weights(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(X.number_weights(F.col("props"))).alias("key", "weight"))


def pages_allowed(spark, d):
    """Pages of allowed hosts, and which of them refuse by their status."""
    status = F.expr("CASE page_id % 5 WHEN 0 THEN 418 WHEN 1 THEN 403 WHEN 2 THEN 204 WHEN 3 THEN 200 END")
    return pages.product_info(pages.allowed(table(spark, d, "pages"), HOSTS), status).select("page_id", "blocked", "title")


def shared_origin(spark, d):
    return catalog.shared(_registry(spark, d)).select("id", "origin_product_no")


def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", S.page_title(F.col("html")).alias("title"))


def page_product_name(spark, d):
    return pages.product_info(table(spark, d, "pages")).select("page_id", "product_name", "blocked")


#: Heads of pages by page_id, %k standing for it; one in six has none.
HEADS = [
    None, '<meta property="og:title" content="Cool &amp;amp; Quiet %k - 네이버 쇼핑"><meta name="description" content="short"><meta property="og:image" content="http://a/%k.png">',
    "<meta content='Second %k' property='og:title'><title>Other</title><META NAME=\"description\" CONTENT=\"\">",
    '<meta property="og:title" content=""><meta content="Never" property="og:title"><meta name="twitter:title" content="Third %k | 쿠팡!">',
    "<title>\n A  title %k : 네이버 </title><meta property='og:description' content='x &lt;%k&gt;'>", "<title>Access Denied %k</title>",
]


def page_meta(spark, d):
    """What pages say about themselves in their heads."""
    head = F.coalesce(filled(HEADS, F.col("page_id"), F.col("page_id")), F.lit(""))
    return pages.product_info(table(spark, d, "pages").select("page_id", F.concat(head, "html").alias("html")))


def page_probe(spark, d):
    return pages.probe(table(spark, d, "pages"), ("the", "product"))


def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalized_url(F.col("url")).alias("url"))


HOSTS = ["example.com", "www.example.net"]


def url_allowed(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", S.allowed_url(url, HOSTS).alias("https_below"), S.allowed_url(url, HOSTS, False, ("http", "https")).alias("exact"), S.is_web_url(url).alias("web"))


def url_parameters(spark, d):
    own = table(spark, d, "pages").select("page_id", F.explode(X.parameters(F.col("url"))).alias("name", "value"))
    return own


def url_links(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.origin_and_path(url).alias("place"), X.digits(url).alias("digits"), X.review_path(url, {"m.therou.example.com": "/m/reviews", "therha.example.com": "/reviews"}).alias("feed"))


def _registry(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("p_partkey div 2").alias("origin_product_no"), F.concat(F.lit("https://shop.example.com/"), F.col("p_partkey")).alias("source_url"))


def duplicate_origin(spark, d):
    return catalog.duplicates(_registry(spark, d))


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    own = _registry(spark, d)
    return own.filter("id % 2 = 0"), own.filter("id % 3 = 0").withColumn("name", F.concat("name", F.lit(" (new)")))


def upsert_products(spark, d):
    return catalog.upsert(*_sides(spark, d)).select("id", "name")


def register_products(spark, d):
    own = _registry(spark, d)
    incoming = own.filter("id % 3 = 0").withColumns({"name": F.concat("name", F.lit(" (new)")), "source_url": F.concat("source_url", F.lit("?new"))})
    return catalog.register(own.filter("id % 4 = 0"), incoming).select("id", "name", "origin_product_no", "source_url")


def insert_products(spark, d):
    return catalog.insert_new(*_sides(spark, d)).select("id", "name")


def update_product(spark, d):
    own = _registry(spark, d).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    return catalog.update(own, 4, F.lit("2025-02-03").cast("timestamp"), name="renamed", origin_product_no=7).select("id", "name", "origin_product_no", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def delete_product(spark, d):
    return catalog.delete(_registry(spark, d), 4).select("id", "name")


def json_extract_scores(spark, d):
    own = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return own.select("event_id", S.usable_score(S.json_number(F.try_variant_get("v", "$.k", "variant"))).alias("score"))


#: Analyses as a model gives them, by event_id; %k stands for the event's own value, a whole number of 0 to 99.
ANALYSES = [
    '{"criterionScores": {"noise": %k.5, "portability": "%k.5", "value": null, "drainage": -%k, "installation": 1%k, "power_consumption": "x%k", "cooling_capacity": "", "durability_service": true}, "criterionReasons": {"noise": " quiet %k ", "value": 3}}',
    '```json\n{"criterionScores": [%k], "criterionReasons": null}\n```', '```\n{"criterionScores": {"noise": %k, "value": false}, "criterionReasons": {"drainage": ""}}\n```', "no json %k",
]


def normalize_scores(spark, d):
    rows = table(spark, d, "events").select("event_id", filled(ANALYSES, F.col("event_id"), F.get_json_object("props", "$.k")).alias("analysis"))
    return reviews.normalized(rows)


def display_date(spark, d):
    text = F.when(F.col("id") % 10 == 0, F.lit("unknown")).otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return product_facts(spark, d).select("id", S.display_date(text).alias("text"))


def analysis_parts(found: DataFrame) -> DataFrame:
    """What an analysis (product, analysis) says: count, summary, confidence, and its scores joined."""
    v = F.try_parse_json("analysis")
    part = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    scores = F.array_join(F.array(*(part(f"criterionScores.{k}", "int") for k in advisor.CRITERION_LABELS)).cast("array<string>"), ",")
    return found.select(F.col("product").cast("long").alias("doc_id"), part("reviewCount", "bigint").alias("review_count"), part("summary", "string").alias("summary"), part("confidenceScore", "int").alias("confidence"), scores.alias("scores"))


def review_analysis_stub(spark, d):
    own = table(spark, d, "documents").select(F.col("doc_id").alias("product"), F.posexplode(reviews.distinct_reviews(F.col("text"))).alias("pos", "review"))
    return analysis_parts(reviews.analyze(own))


def stream_distinct_events(spark, d):
    """Events as a stream, each event_id once; read as files arrive, and written until all there are is read."""
    at = new_path(spark, "stream")
    # all there is comes in one batch, which the watermark follows; ids stay in the state for a day of event time behind it
    schema = table(spark, d, "events").schema
    events = distinct_events(spark.readStream.schema(schema).parquet(f"{d}/events*.parquet"), "1 day")
    events.select("event_id", "event_type", "value").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "recommend_budget": _recommended(BUDGET, WEIGHTS), "recommend_no_budget": _recommended(0, EQUAL), "recommend_reasons": recommend_reasons, "recommend_cautions": recommend_cautions,
        "market_top5": market_top5, "market_top5_per_category": market_top5_per_category, "market_breakdown": market_breakdown, "market_reasons": market_reasons,
        "catalog_search": catalog_search, "catalog_sort_analysis": _sorted("analysis"), "catalog_sort_confidence": _sorted("confidence"), "catalog_sort_newest": _sorted("newest"), "catalog_sort_created": _sorted("created"),
        "catalog_sort_name_ko": catalog_sort_name_ko, "analyzed_count": analyzed_count, "products_by_ids": products_by_ids, "product_pick": product_pick,
        "advisor_match": advisor_match, "advisor_match_per_category": advisor_match_per_category, "advisor_match_long": advisor_match_long, "advisor_winner_top4": advisor_winner_top4, "recommend_rank_lineitem": recommend_rank_lineitem, "advisor_breakdown": advisor_breakdown,
        "advisor_strongest3": advisor_strongest3, "advisor_weakest2": advisor_weakest2, "advisor_cautions": advisor_cautions,
        "advisor_answers": advisor_answers, "advisor_match_in_category": advisor_match_in_category, "advisor_reasons": advisor_reasons, "catalog_search_brand": catalog_search_brand, "product_links": product_links, "review_requests": review_requests,
        "weights_adjusted": weights_adjusted, "weights_top4": weights_top4, "analysis_join_weights": analysis_join_weights,
        "reviews_clean_dedupe": reviews_clean_dedupe, "reviews_cap100": reviews_cap100, "reviews_dedupe_by_key": reviews_dedupe_by_key, "review_analysis_stub": review_analysis_stub,
        "review_messages_once": review_messages_once, "review_collection": review_collection, "session_weights": session_weights, "event_weights": event_weights, "pages_allowed": pages_allowed, "shared_origin": shared_origin,
        "page_title": page_title, "page_product_name": page_product_name, "page_meta": page_meta, "page_probe": page_probe, "url_normalize": url_normalize, "url_allowed": url_allowed, "url_parameters": url_parameters, "url_links": url_links,
        "duplicate_origin": duplicate_origin, "upsert_products": upsert_products, "register_products": register_products, "insert_products": insert_products, "update_product": update_product, "delete_product": delete_product,
        "json_extract_scores": json_extract_scores, "normalize_scores": normalize_scores, "display_date": display_date, "stream_distinct_events": stream_distinct_events,
    }


# --- SQL --------------------------------------------------------------------------------------------------------------


def _quote(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)})"


def _filled_sql(texts: list[str | None], at: str, value: str) -> str:
    return f"CASE {at} % {len(texts)} " + " ".join(f"WHEN {k} THEN replace({_quote(t)}, '%k', ({value})::VARCHAR)" for k, t in enumerate(texts) if t is not None) + " END"


def _lists(parts: list[str]) -> str:
    """An array of those of these that are not null."""
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _unnested(source: str, items: str, name: str, key: str = "id") -> str:
    return f"SELECT {key}, generate_subscripts(xs, 1)::INTEGER AS pos, unnest(xs) AS {name} FROM (SELECT {key}, {items} AS xs FROM {source})"


def _product_name_sql(x: str) -> str:
    for shop in S.SHOP_SUFFIXES:
        x = f"regexp_replace({x}, '(?i){_RX}*[:|\\-]{_RX}*{shop}[^\\n\\r\\x{{2028}}\\x{{2029}}]*$', '')"
    return f"nullif({_collapse(x)}, '')"


def _meta_sql(attribute: str, value: str) -> str:
    named = f"{attribute}=[\"'']{value.replace(':', '[:]')}[\"'']"
    before = f"(?i)<meta[^>]+{named}[^>]+content=[\"'']([^\"'']*)[\"''][^>]*>"
    behind = f"(?i)<meta[^>]+content=[\"'']([^\"'']*)[\"''][^>]+{named}[^>]*>"
    return f"nullif({_decode(f'''CASE WHEN regexp_matches(html, '{before}') THEN regexp_extract(html, '{before}', 1) ELSE regexp_extract(html, '{behind}', 1) END''')}, '')"


def _page_info_sql(source: str) -> str:
    blocked = " OR ".join(f"contains(html, '{m}')" for m in S.BLOCK_MARKERS)
    raw = "nullif(regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1), '')"
    return f"""SELECT page_id, coalesce({blocked}, false) AS blocked, coalesce({_meta_sql("property", "og:title")}, {_meta_sql("name", "twitter:title")}, {_decode(raw)}) AS title,
  coalesce({_meta_sql("property", "og:description")}, {_meta_sql("name", "description")}) AS description, {_meta_sql("property", "og:image")} AS image FROM {source}"""


def oracle_sql() -> dict[str, str]:
    said = lambda c: f"CASE WHEN {c} >= 88 THEN '{FIVE_CRITERIA[c]} 점수가 높아 선택 조건과 잘 맞습니다.' END"
    ranked = sorted(WEIGHTS, key=lambda c: -WEIGHTS[c])
    amount = f"regexp_replace(regexp_replace(format('{{:t,.3f}}', price - {BUDGET}), '0+$', ''), '[.]$', '')"
    reg = "reg AS (SELECT p_partkey AS id, p_name AS name, p_partkey // 2 AS origin, 'https://shop.example.com/' || p_partkey AS url FROM part), old AS (SELECT * FROM reg WHERE id % 2 = 0), inc AS (SELECT id, name || ' (new)' AS name, origin, url FROM reg WHERE id % 3 = 0)"
    sort = lambda order: f"WITH {PF} SELECT id, row_number() OVER (ORDER BY {order}, id) AS rank FROM pf QUALIFY rank <= 10"
    rules = _values([(q, a, k, v, i) for i, (q, a, k, v) in enumerate(advisor.RULES)], "rules", "question, answer, key, delta, rank_at")
    said_by = " UNION ALL ".join(f"SELECT c_custkey AS session, '{q}' AS question, CASE c_custkey // {n} % {len(a)} {' '.join(f'WHEN {k} THEN {_quote(x)}' for k, x in enumerate(a))} END AS answer FROM customer" for q, (n, a) in ANSWERS.items())
    adjusted = f"""WITH st AS (SELECT c_custkey AS session, 'noise' AS key, c_nationkey / 2.0::DOUBLE AS weight, 0 AS ord FROM customer UNION ALL SELECT c_custkey, 'value', c_acctbal / 1000, 1 FROM customer WHERE c_custkey % 3 <> 0), an AS ({said_by}), {rules},
ad AS (SELECT session, key, sum(delta) AS delta, min(rank_at) AS pos FROM an JOIN rules USING (question, answer) GROUP BY ALL),
w AS (SELECT session, key, least(10.0, greatest(0.0, coalesce(weight, 0.0)) + coalesce(delta, 0))::DOUBLE AS weight, coalesce(ord, 1000 + pos)::INTEGER AS ord FROM st FULL JOIN ad USING (session, key))"""
    lines = f"list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda s: {_collapse('s')}), lambda s: s <> '')"
    first_lines = f"""WITH l AS (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS review FROM (SELECT doc_id, {lines} AS xs FROM documents)),
f AS (SELECT doc_id, review, min(i) AS i FROM l GROUP BY ALL)"""
    host = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
    scheme = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1))"
    bare = "regexp_replace(url, '[?#].*$', '')"
    items = _items_sql()
    strong = f"{items}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score * weight DESC, ord)::INTEGER AS pos FROM i WHERE score IS NOT NULL)"
    weak = f"{items}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, ord)::INTEGER AS pos FROM i WHERE score IS NOT NULL)"
    strings = lambda c: f"coalesce(list_transform(list_filter(CASE WHEN json_type({c}) = 'ARRAY' THEN json_extract({c}, '$[*]') END, lambda v: json_type(v) = 'VARCHAR' AND {_trim(chr(40) + 'v ->> ' + chr(39) + '$' + chr(39) + chr(41))} <> ''), lambda v: {_trim(chr(40) + 'v ->> ' + chr(39) + '$' + chr(39) + chr(41))})[1:2], [])"
    point = "concat_ws(': ', nullif(v ->> '$.topic', ''), nullif(v ->> '$.summary', ''))"
    points = f"coalesce(list_filter(list_transform(CASE WHEN json_type(negatives) = 'ARRAY' THEN json_extract(negatives, '$[*]') END, lambda v: {point}), lambda t: t <> '')[1:2], [])"
    number = lambda x: f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"
    low = lambda c, label: f"'{label} 점수는 ' || {number(c)} || '점으로 상대적으로 낮습니다.'"
    good = f"label || '{GOOD_SCORE[0]}' || {number('weight')} || '{GOOD_SCORE[1]}' || {number('score')} || '{GOOD_SCORE[2]}'"
    short = f"label || '{LOW_SCORE[0]}' || {number('score')} || '{LOW_SCORE[1]}'"
    raw_title = "nullif(regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]*?)</title>', 1), '')"
    score_keys = list(advisor.CRITERION_LABELS)
    num = "CASE WHEN json_type(x) = 'NULL' THEN NULL WHEN json_type(x) = 'BOOLEAN' THEN (x::BOOLEAN)::INTEGER::DOUBLE WHEN json_type(x) = 'VARCHAR' THEN CASE WHEN (x ->> '$') = '' THEN 0.0 ELSE try_cast(x ->> '$' AS DOUBLE) END ELSE try_cast(x AS DOUBLE) END"
    return {
        "recommend_budget": f"WITH {PF} SELECT id, {_score_sql(BUDGET, WEIGHTS)} AS score, row_number() OVER (ORDER BY {_score_sql(BUDGET, WEIGHTS)} DESC, id) AS rank FROM pf",
        "recommend_no_budget": f"WITH {PF} SELECT id, {_score_sql(0, EQUAL)} AS score, row_number() OVER (ORDER BY {_score_sql(0, EQUAL)} DESC, id) AS rank FROM pf",
        "recommend_reasons": f"WITH {PF} {_unnested('pf', f'''list_concat({_lists([f"CASE WHEN price <= {BUDGET} THEN '설정한 예산 범위에 들어옵니다.' END"])}, ({_lists([said(c) for c in ranked])})[1:3])''', 'reason')}",
        "recommend_cautions": f"WITH {PF} {_unnested('pf', f'''list_concat({_lists([f"CASE WHEN price > {BUDGET} THEN '예산보다 ' || {amount} || '원 높습니다.' END"])}, [name, brand])[1:3]''', 'caution')}",
        "market_top5": f"{_market_sql()} SELECT id, market_score, row_number() OVER (ORDER BY {_MARKET_ORDER}) AS rank FROM m QUALIFY rank <= 5",
        "market_top5_per_category": f"{_market_sql('category')} SELECT category, id, market_score, row_number() OVER (PARTITION BY category ORDER BY {_MARKET_ORDER}) AS rank FROM m QUALIFY rank <= 5",
        "market_breakdown": f"{_market_sql()} SELECT id, market_score, {', '.join('part_' + p for p in _MARKET)} FROM m",
        "market_reasons": f"{_market_sql()}, " + f"""q AS (SELECT id, {_lists(["CASE WHEN sales_rank_score >= 85 THEN '판매 지표가 우수한 시장 인기 제품' END",
            "CASE WHEN review_count >= 1000 THEN '누적 리뷰가 많아 평가 신뢰도가 높은 제품' WHEN review_count >= 500 THEN '충분한 실사용 리뷰가 축적된 제품' END",
            "CASE WHEN review_score >= 88 THEN '실사용자 만족도가 높은 제품' END", "CASE WHEN brand_trust_score >= 85 THEN '브랜드와 고객지원 신뢰도가 높은 제품' END", "CASE WHEN popularity_score >= 85 THEN '시장 관심도와 인지도가 높은 제품' END",
            "CASE WHEN recency_score >= 85 THEN '비교적 최신 제품으로 시장성이 유지되는 제품' END", "CASE WHEN availability_score >= 85 THEN '현재 구매 가능성과 유통 접근성이 좋은 제품' END"])} AS r FROM m)
            {_unnested('q', "CASE WHEN len(r) = 0 THEN ['판매, 리뷰, 브랜드, 관심도를 종합한 시장 점수가 양호한 제품'] ELSE r END", 'reason')}""",
        "catalog_search": f"WITH {PF} SELECT id, name, category FROM pf WHERE analyzed AND (contains(lower(name), 'small') OR contains(lower(category), 'small'))",
        "catalog_sort_analysis": sort("analyzed DESC, coalesce(confidence, -1) DESC"), "catalog_sort_confidence": sort("coalesce(confidence, -1) DESC"),
        "catalog_sort_newest": sort("updated_at DESC NULLS LAST"), "catalog_sort_created": sort("created_at DESC NULLS FIRST"),
        "catalog_sort_name_ko": f"""WITH n AS (SELECT l_orderkey, l_linenumber AS id, CASE l_partkey % {len(NAMES)} {" ".join(f"WHEN {k} THEN {_quote(x)}" for k, x in enumerate(NAMES))} END || ' ' || l_partkey // 3 AS name FROM lineitem)
  SELECT l_orderkey, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY name COLLATE ko, id) AS rank FROM n""",
        "analyzed_count": f"WITH {PF} SELECT count(*) FILTER (analyzed) AS n FROM pf",
        "products_by_ids": f"WITH {PF} SELECT id, name FROM pf WHERE id IN (1, 3, 7, 100)",
        "product_pick": f"WITH {PF} SELECT id, name FROM pf ORDER BY id LIMIT 1",
        "advisor_match": f"{_advisor_sql()} SELECT id, match_score, coverage, sure, row_number() OVER (ORDER BY match_score DESC, sure DESC, id) AS rank FROM m WHERE contains(category, '{CATEGORY}') QUALIFY rank <= 5",
        "advisor_match_per_category": f"{_advisor_sql()} SELECT category, id, match_score, coverage, sure, row_number() OVER (PARTITION BY category ORDER BY match_score DESC, sure DESC, id) AS rank FROM m QUALIFY rank <= 5",
        "advisor_match_in_category": f"{_advisor_sql()} SELECT id, match_score, coverage, sure, row_number() OVER (ORDER BY match_score DESC, sure DESC, id) AS rank FROM m WHERE category = '{ONE_CATEGORY}' QUALIFY rank <= 5",
        "advisor_reasons": f"{strong} SELECT id, pos, {good} AS reason FROM r WHERE pos <= 3",
        "advisor_answers": f"""{_advisor_sql()}, w AS (SELECT *, row_number() OVER (ORDER BY match_score DESC, sure DESC, id) AS rank FROM m WHERE contains(category, '{CATEGORY}') QUALIFY rank <= 5),
  i AS ({" UNION ALL ".join(f"SELECT id, {k} AS ord, '{key}' AS key, '{advisor.CRITERION_LABELS[key]}' AS label, {_scores_sql.get(key, 'NULL::DOUBLE')} AS score, {w}::DOUBLE AS weight FROM w" for k, (key, w) in enumerate(_active.items()))}),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score * weight DESC NULLS LAST, ord) AS up, row_number() OVER (PARTITION BY id ORDER BY score NULLS LAST, ord) AS down FROM i),
  t AS (SELECT id, string_agg({good}, '|' ORDER BY up) FILTER (up <= 3 AND score IS NOT NULL) AS reasons, 'loud|size: too big|' || string_agg({short}, '|' ORDER BY down) FILTER (down <= 2 AND score IS NOT NULL) AS cautions,
        string_agg(key || '=' || CASE WHEN key = 'noise' THEN 'quiet' ELSE '{NO_REASON_STORED}' END, '|' ORDER BY weight DESC, ord) AS criteria FROM r GROUP BY id)
  SELECT id, rank, match_score, coverage, sure, review_count::DOUBLE AS review_count, CASE WHEN id % 2 = 0 THEN 'about ' || id ELSE '{NO_SUMMARY}' END AS summary, reasons, cautions, 'car|tent|van' AS best_for, criteria FROM w JOIN t USING (id)""",
        "catalog_search_brand": f"WITH {PF} SELECT id, brand FROM pf WHERE contains(lower(name), 'brand#1') OR contains(lower(category), 'brand#1') OR contains(lower(brand), 'brand#1')",
        "product_links": f"WITH {PF} SELECT id, '/advisor?category=' || url_encode(category) || coalesce('&confidence=' || confidence, '') AS link FROM pf",
        "review_requests": """WITH r AS (SELECT p_partkey AS id, p_size, greatest(1, least(100, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_size * 3 - 20 END, 20))) AS n FROM part)
  SELECT id, n::INTEGER AS requested, ceil(n / 20.0)::INTEGER AS pages, id % 3 <> 0 AND p_size > 9 AS ready FROM r""",
        "advisor_match_long": f"{_advisor_sql()} SELECT id, match_score, coverage FROM m",
        "advisor_breakdown": f"{items} SELECT id, row_number() OVER (PARTITION BY id ORDER BY weight DESC, ord)::INTEGER AS pos, key, label, score, weight, CASE WHEN score * weight = floor(score * weight) THEN score * weight ELSE round((score * weight)::DECIMAL(38, 18), 1)::DOUBLE END AS contribution FROM i",
        "advisor_strongest3": f"{strong} SELECT id, pos, key FROM r WHERE pos <= 3", "advisor_weakest2": f"{weak} SELECT id, pos, key FROM r WHERE pos <= 2",
        "advisor_cautions": f"""WITH {PF}, c AS (SELECT id, ({_filled_sql(CAUTIONS, 'id', 'id')})::JSON AS cautions, ({_filled_sql(NEGATIVES, 'id', 'id')})::JSON AS negatives, {_scores_sql["noise"]} AS noise, {_scores_sql["portability"]} AS portability FROM pf),
  w AS (SELECT id, list_concat(list_concat({strings("cautions")}, {points}), list_filter(CASE WHEN noise <= portability THEN [{low("noise", "소음")}, {low("portability", "휴대성")}] ELSE [{low("portability", "휴대성")}, {low("noise", "소음")}] END, lambda x: x IS NOT NULL)) AS xs FROM c),
  e AS (SELECT id, generate_subscripts(xs, 1) AS i, unnest(xs) AS caution FROM w), f AS (SELECT id, caution, min(i) AS i FROM e GROUP BY ALL)
  SELECT id, caution, row_number() OVER (PARTITION BY id ORDER BY i)::INTEGER AS pos FROM f QUALIFY pos <= 4""",
        "weights_adjusted": f"{adjusted} SELECT * FROM w", "weights_top4": f"{adjusted} SELECT session, key, row_number() OVER (PARTITION BY session ORDER BY weight DESC, ord) AS rank FROM w QUALIFY rank <= 4",
        "analysis_join_weights": f"""WITH {_values(CRITERIA, 'c', 'key, d, ord')}, w AS (SELECT c_custkey, 'noise' AS key, c_acctbal / 1000 AS weight FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'drainage', c_nationkey::DOUBLE FROM customer WHERE c_custkey % 3 > 0)
  SELECT c_custkey, key, coalesce(weight, d)::DOUBLE AS weight, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(weight, d)::DOUBLE DESC, ord) AS rank FROM (SELECT c_custkey, c.* FROM customer, c) LEFT JOIN w USING (c_custkey, key) QUALIFY rank <= 3""",
        "reviews_clean_dedupe": f"{first_lines} SELECT doc_id, review, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS pos FROM f",
        "reviews_cap100": f"{first_lines} SELECT doc_id, least(100, count(i))::INTEGER AS n FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
        "reviews_dedupe_by_key": f"""WITH t AS (SELECT conv_id, turn, {_collapse("text")} AS text FROM conversations WHERE role = 'user'),
  k AS (SELECT *, coalesce(CASE WHEN turn % 4 = 0 THEN 'first' END, text) AS key FROM t WHERE text <> ''), f AS (SELECT conv_id, key, min(turn) AS turn FROM k GROUP BY ALL)
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM k JOIN f USING (conv_id, key, turn) QUALIFY pos <= 100""",
        "review_messages_once": f"""WITH l AS (SELECT conv_id, turn, generate_subscripts(xs, 1) AS i, unnest(xs) AS review FROM (SELECT conv_id, turn, {lines} AS xs FROM conversations)),
  f AS (SELECT conv_id, turn, review, min(i) AS i FROM l WHERE turn <> 0 GROUP BY conv_id, turn, review QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) <= 100),
  m AS (SELECT conv_id, turn, count(*)::INTEGER AS n, md5(string_agg(review, chr(10) ORDER BY i)) AS digest FROM f GROUP BY conv_id, turn QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
  SELECT conv_id, turn, CASE WHEN conv_id % 10 <> 3 THEN n END AS n, CASE WHEN conv_id % 10 <> 3 THEN digest END AS digest FROM m""",
        "review_collection": f"""WITH l AS (SELECT doc_id, unnest(xs) AS raw, generate_subscripts(xs, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents)),
  p AS (SELECT doc_id, i // 20 AS page, count(*) AS n FROM l GROUP BY ALL),
  e AS (SELECT doc_id, min(page) AS stop FROM p WHERE page < 2 AND (n < 20 OR doc_id % 11 = 0 AND page = 1) GROUP BY doc_id),
  c AS (SELECT l.doc_id, i, {_collapse("raw")} AS content, CASE WHEN length(raw) % 7 = 0 THEN 'n' || length(raw) END AS id FROM l LEFT JOIN e USING (doc_id)
        WHERE i < 40 AND NOT (doc_id % 11 = 0 AND i // 20 = 1) AND (stop IS NULL OR i // 20 <= stop)),
  f AS (SELECT doc_id, i, content FROM c WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, coalesce(id, content) ORDER BY i) = 1),
  o AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM f)
  SELECT doc_id, pos, content FROM o LEFT JOIN e USING (doc_id) WHERE pos <= 25 AND NOT coalesce(doc_id % 11 = 0 AND stop = 1 AND n < 25, FALSE)""",
        "session_weights": """SELECT c_custkey, 'noise' AS key, greatest(0, least(10, c_acctbal / 500)) AS weight FROM customer WHERE c_acctbal IS NOT NULL
  UNION ALL SELECT c_custkey, 'value', greatest(0, least(10, c_nationkey::DOUBLE)) FROM customer WHERE c_nationkey IS NOT NULL""",
        "event_weights": "SELECT event_id, key, greatest(0, least(10, (props ->> ('$.' || key))::DOUBLE)) AS weight FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE json_type(props, '$.' || key) IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
        "pages_allowed": f"""WITH p AS (SELECT *, CASE page_id % 5 WHEN 0 THEN 418 WHEN 1 THEN 403 WHEN 2 THEN 204 WHEN 3 THEN 200 END AS status FROM pages WHERE {scheme} = 'https' AND ({' OR '.join(f"{host} = '{h}' OR ends_with({host}, '.{h}')" for h in HOSTS)})),
  i AS (SELECT page_id, title, blocked OR coalesce(status NOT BETWEEN 200 AND 299, FALSE) AS blocked FROM ({_page_info_sql('p')}) JOIN p USING (page_id))
  SELECT page_id, blocked, CASE WHEN NOT blocked THEN title END AS title FROM i""",
        "shared_origin": f"WITH {reg} SELECT id, origin AS origin_product_no FROM reg QUALIFY count(*) OVER (PARTITION BY origin) > 1",
        "page_title": f"SELECT page_id, {_decode(raw_title)} AS title FROM pages",
        "page_product_name": f"SELECT page_id, CASE WHEN NOT blocked THEN {_product_name_sql('title')} END AS product_name, blocked FROM ({_page_info_sql('pages')})",
        "page_meta": f"WITH h AS (SELECT page_id, coalesce({_filled_sql(HEADS, 'page_id', 'page_id')}, '') || html AS html FROM pages) SELECT page_id, blocked, CASE WHEN NOT blocked THEN {_product_name_sql('title')} END AS product_name, CASE WHEN NOT blocked THEN title END AS title, CASE WHEN NOT blocked THEN description END AS description, CASE WHEN NOT blocked THEN image END AS image FROM ({_page_info_sql('h')})",
        "page_probe": f"SELECT page_id, length(html) AS html_length, contains(html, 'the') OR contains(html, 'product') AS has_marker, {_trim(raw_title)} AS title FROM pages",
        "url_normalize": f"SELECT page_id, regexp_replace({scheme} || '://' || {host} || substr({bare}, length(regexp_extract({bare}, '^[A-Za-z]+://[^/]*')) + 1), '/$', '') AS url FROM pages",
        "url_allowed": f"SELECT page_id, {scheme} = 'https' AND ({' OR '.join(f'''{host} = '{h}' OR ends_with({host}, '.{h}')''' for h in HOSTS)}) AS https_below, {scheme} IN ('http', 'https') AND {host} IN ({', '.join(map(_quote, HOSTS))}) AS exact, {scheme} IN ('http', 'https') AS web FROM pages",
        "url_parameters": """WITH p AS (SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT page_id, string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS ps FROM pages))
  SELECT page_id, url_decode(split_part(p, '=', 1)) AS name, url_decode(regexp_replace(p, '^[^=]*=?', '')) AS value FROM p WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY i) = 1""",
        "url_links": f"SELECT page_id, {scheme} || '://' || {host} || regexp_extract({bare}, '^[A-Za-z]+://[^/]*(.*)', 1) AS place, regexp_replace(url, '[^0-9]', '', 'g') AS digits, CASE {host} WHEN 'm.therou.example.com' THEN '/m/reviews' WHEN 'therha.example.com' THEN '/reviews' END AS feed FROM pages",
        "duplicate_origin": f"WITH {reg} SELECT a.id, b.id AS other_id FROM reg a JOIN reg b ON a.origin = b.origin AND a.id <> b.id",
        "upsert_products": f"WITH {reg} SELECT id, name FROM old WHERE id NOT IN (SELECT id FROM inc) UNION ALL SELECT id, name FROM inc",
        "register_products": f"""WITH {reg}, o AS (SELECT * FROM reg WHERE id % 4 = 0), i AS (SELECT id, name || ' (new)' AS name, origin, url || '?new' AS url FROM reg WHERE id % 3 = 0)
  SELECT o.id, coalesce(i.name, o.name) AS name, o.origin AS origin_product_no, coalesce(i.url, o.url) AS source_url FROM o LEFT JOIN i ON i.origin = o.origin OR i.url = o.url
  UNION ALL SELECT id, name, origin, url FROM i WHERE NOT EXISTS (FROM o WHERE o.origin = i.origin OR o.url = i.url)""",
        "advisor_winner_top4": _advisor_sql() + f", w AS (SELECT * FROM m WHERE contains(category, '{CATEGORY}') ORDER BY match_score DESC, sure DESC NULLS LAST, id LIMIT 1), c AS (" + " UNION ALL ".join(f"SELECT id, '{key}' AS key, {w}::DOUBLE AS weight, {k} AS ord, {_scores_sql[key]} AS score FROM w" for k, (key, w) in enumerate(_active.items()) if key in SCORED) + ") SELECT id, row_number() OVER (ORDER BY weight DESC, ord) AS pos, key, weight FROM c WHERE score IS NOT NULL QUALIFY pos <= 4",
        "recommend_rank_lineitem": "SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS price, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem",
        "insert_products": f"WITH {reg} SELECT id, name FROM old UNION ALL SELECT id, name FROM inc WHERE origin NOT IN (SELECT origin FROM old) AND url NOT IN (SELECT url FROM old)",
        "update_product": f"WITH {reg} SELECT id, CASE WHEN id = 4 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 4 THEN 7 ELSE origin END AS origin_product_no, CASE WHEN id = 4 THEN '2025-02-03' ELSE '2024-01-01' END AS updated FROM reg",
        "delete_product": f"WITH {reg} SELECT id, name FROM reg WHERE id <> 4",
        "json_extract_scores": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (props ->> '$.k')::DOUBLE BETWEEN 0 AND 100 THEN (props ->> '$.k')::DOUBLE END AS score FROM events",
        "normalize_scores": f"""WITH r AS (SELECT event_id AS id, {_filled_sql(ANALYSES, "event_id", "props ->> '$.k'")} AS analysis FROM events),
  p AS (SELECT id, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM (SELECT id, trim(regexp_replace(regexp_replace(analysis, '^```(json)?', ''), '```$', ''), chr(10) || ' ') AS t FROM r)),
  k(ord, key) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(score_keys))}),
  v AS (SELECT id, key, json_extract(j, '$.criterionScores.' || key) AS x, json_extract(j, '$.criterionReasons.' || key) AS y FROM p, k)
  SELECT id AS event_id, key, CASE WHEN {num} IS NOT NULL THEN greatest(0.0, least(100.0, floor({num} + 0.5))) END AS score, CASE WHEN json_type(y) = 'VARCHAR' THEN trim(y ->> '$') ELSE '리뷰에서 판단할 근거가 충분하지 않습니다.' END AS reason FROM v""",
        "display_date": f"WITH {PF} SELECT id, CASE WHEN id % 10 = 0 THEN '-' ELSE strftime(created_at, '%Y. %m. %d.') END AS text FROM pf",
        "stream_distinct_events": "SELECT event_id, event_type, value FROM events",
        "review_analysis_stub": f"""{first_lines}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f QUALIFY n <= 100), g AS (SELECT doc_id, count(*) AS n, sum(length(review))::BIGINT AS s, min_by(review, n) AS head FROM n GROUP BY doc_id)
  SELECT doc_id, n AS review_count, left(head, 40) AS summary, least(100, 5 * n)::INTEGER AS confidence, concat_ws(',', {", ".join(f"s * {k + 3} % 101" for k in range(len(score_keys)))}) AS scores FROM g""",
    }
