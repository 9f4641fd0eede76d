"""Queries of the registry's upkeep by name: registration with outcomes, versions, review feeds as streams, request bodies,
lookups, dates. With SQL for DuckDB that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import exchange as X
from decidra.functions import scalars as S
from decidra.operators import catalog, registry, requests, reviews
from decidra.plans import catalogue
from decidra.sources.readers import static_products, table
from decidra.sources.scratch import new_path, written
from decidra.schemas import CRITERION_LABELS
from decidra.sources.versions import Versions
from decidra.streaming import analysis, feed
from decidra.streaming.reviews import distinct_events

NOW = "2025-02-03 04:05:06"

# --- registration: parts are products; a fourth is registered, a third comes in ---------------------------------------


def _registered(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").filter("p_partkey % 4 = 0")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return own.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("product_name"), F.concat(F.lit("https://shop.example.com/"), "p_partkey").alias("source_url"),
        F.expr("p_partkey div 2").alias("origin_product_no"), F.when(F.col("p_partkey") % 8 == 0, F.concat(F.lit('{"n": '), "p_partkey", F.lit("}"))).alias("review_analysis"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """Some know a registered number, some a registered address, some both of different products; some share new ones."""
    k = F.col("p_partkey")
    url = F.when(k % 9 == 0, F.concat(F.lit("x"), F.floor(k / 27))).when(k % 12 == 3, (k + 1).cast("string")).otherwise(F.concat(F.lit("n"), k))
    return table(spark, d, "part").filter("p_partkey % 3 = 0").select(
        (k + 10_000_000_000).alias("id"), F.lit("CAT").alias("category"), F.concat("p_name", F.lit(" (new)")).alias("product_name"), F.concat(F.lit("https://shop.example.com/"), url).alias("source_url"),
        F.when(k % 9 != 0, F.floor(k / 12) * 6).alias("origin_product_no"),
    )


def _registration(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return registry.register(_registered(spark, d), _incoming(spark, d), F.lit(NOW).cast("timestamp"))


def _shown(rows: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("id", "category", "product_name", "source_url", "origin_product_no", "review_analysis", text("created_at"), text("updated_at"))


def register_outcomes(spark, d):
    return _registration(spark, d)[1]


def register_keeps_analysis(spark, d):
    """The registry after registration: what is known keeps its analysis and created_at."""
    return _shown(_registration(spark, d)[0])


def insert_outcomes(spark, d):
    return registry.insert(_registered(spark, d), _incoming(spark, d), F.lit(NOW).cast("timestamp"))[1]


def registry_versions(spark, d):
    """Three commits to a versioned table, and what each version holds when all are there."""
    store = Versions(spark, new_path(spark, "registry"), unique=("id", *registry.KEYS))
    now = F.lit(NOW).cast("timestamp")
    first = store.commit(_registered(spark, d), 0, "start")
    second = store.commit(registry.register(store.read(first), _incoming(spark, d), now)[0], first, "registered")
    third = store.commit(store.read().filter("id % 5 <> 0"), second, "deleted")
    out = None
    for n in (first, second, third):
        own = _shown(store.read(n)).withColumn("version", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


# --- streams ----------------------------------------------------------------------------------------------------------


def _feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as pages of 20 reviews; some second pages fail."""
    lines = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), ((F.size(lines) - 1) / 20).cast("int")), lambda p: F.slice(lines, p * 20 + 1, 20))
    each = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("product"), F.size(cut).alias("n"), F.posexplode(cut).alias("page", "own"))
    review = lambda r: F.struct(F.when(F.length(r) % 7 == 0, F.concat(F.lit("n"), F.length(r))).alias("id"), r.alias("content"))
    status = F.when((F.col("product") % 11 == 0) & (F.col("page") == 1), 500)
    return each.select("product", "page", status.alias("status"), (F.col("page") == F.col("n") - 1).alias("last"), F.transform("own", review).alias("contents"))


def stream_review_collection(spark, d):
    """Reviews collected from a feed that is read a page of each product at a time; published when a product's feed ends."""
    at = new_path(spark, "feed")
    _feed_pages(spark, d).filter("page < 3").write.partitionBy("page").json(f"{at}/pages")
    found = feed.collected_stream(feed.review_feed(spark, f"{at}/pages"), most=25)
    query = found.writeStream.foreachBatch(feed.published(f"{at}/out")).option("checkpointLocation", f"{at}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(f"{feed.COLLECTED}, batch int").parquet(f"{at}/out").select(F.col("product").cast("long").alias("doc_id"), "pos", "content")


def stream_messages_once(spark, d):
    """Messages as they arrive, in three files; the first of each conversation is processed, in whichever batch it is."""
    at = new_path(spark, "messages")
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("product"), F.col("turn").alias("at"), reviews.distinct_reviews(F.col("text")).alias("said"))
    about = F.when(F.col("product") % 10 == 3, F.lit("another")).otherwise(F.col("product").cast("string"))
    message = X.transfer_message(F.when(F.col("at") == 0, F.lit("other")).otherwise(F.lit("reviews")), about, F.col("said"), sourceUrl=F.lit("https://shop.example.com/1"))
    sent = written(own.select("product", "at", message.alias("message")).filter("message is not null"), "sent")
    schema, write = sent.schema, feed.first_messages_published(f"{at}/out", "reviews")
    for part, turns in enumerate(("at < 2", "at between 2 and 4", "at > 4")):
        sent.filter(turns).write.mode("append").parquet(f"{at}/in/part={part}")
        arrived = spark.readStream.schema(schema).parquet(f"{at}/in/part=*")
        arrived.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    first = spark.read.parquet(f"{at}/out")
    return first.select(F.col("product").alias("conv_id"), F.col("at").alias("turn"), F.size("reviews").alias("n"), F.md5(F.array_join("reviews", "\n")).alias("digest"))


def stream_events_once(spark, d):
    """Events of which every third arrives twice: each event_id once. Ids are kept for a day of event time."""
    at = new_path(spark, "events")
    own = table(spark, d, "events")
    own.unionByName(own.filter("event_id % 3 = 0")).write.parquet(f"{at}/in")
    events = distinct_events(spark.readStream.schema(own.schema).parquet(f"{at}/in"), "1 day")
    events.select("event_id", "event_type", "value").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def stream_analyses(spark, d):
    """Analyses that follow the lines of documents, which arrive in three parts, each read by a query of its own from one checkpoint:
    the last analysis of each document."""
    at = new_path(spark, "analyses")
    # by the line feed alone, as white space at the ends of a review counts for nothing; parts are cut from the texts, so no table of all lines is written
    lines = F.split("text", "\n")
    for part, (low, high) in enumerate(((0, 2), (1, 6), (5, None))):
        own = F.slice(lines, F.lit(low + 1), F.greatest(F.size(lines) - low, F.lit(0)) if high is None else F.lit(high - low))
        sent = table(spark, d, "documents").select(F.col("doc_id").alias("product"), F.posexplode(own).alias("pos", "review")).withColumn("pos", F.col("pos") + low)
        sent.write.parquet(f"{at}/in/part={part}")
        arrived = spark.readStream.schema(sent.schema).parquet(f"{at}/in/part=*")
        arrived.writeStream.foreachBatch(analysis.analyses_published(f"{at}/out", most=100)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return catalogue.analysis_parts(analysis.latest(spark, f"{at}/out"))


# --- request bodies, lookups, dates -----------------------------------------------------------------------------------

#: Bodies by event_id modulo 8; %k stands for the event's own value, a whole number of 0 to 99.
BODIES = [
    '{"checkoutMerchantNo": %k, "originProductNo": "7%k"}', '{"checkoutMerchantNo": 5, "originProductNo": %k, "maxReviews": %k}', '{"checkoutMerchantNo": "x%k", "originProductNo": 1}', '{"checkoutMerchantNo": true, "originProductNo": %k.5}',
    "[%k]", '{"checkoutMerchantNo": 3', '{"checkoutMerchantNo": 2, "originProductNo": 9, "maxReviews": "%k"}', '{"checkoutMerchantNo": null, "originProductNo": %k, "maxReviews": null}',
]


def request_bodies(spark, d):
    """Requests read from JSON bodies; each is sound, or has the guard that it fails."""
    k = F.get_json_object("props", "$.k")
    body = F.lit(None).cast("string")
    for at, text in reversed(list(enumerate(BODIES))):
        body = F.when(F.col("event_id") % 8 == at, F.replace(F.lit(text), F.lit("%k"), k)).otherwise(body)
    return requests.collection_requests(table(spark, d, "events").select("event_id", body.alias("body"))).select("event_id", "merchant_no", "origin_no", "max_reviews", "rejected")


def lookup_profiles(spark, d):
    """Orders with the one customer row of their key, asserted when the query runs."""
    profiles = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    wanted = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return requests.looked_up(wanted, profiles, "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


#: Date texts by o_orderkey modulo 8.
FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'+09:00'", "yyyy/MM/dd", "MMM d, yyyy", "'Thu, 'dd MMM yyyy HH:mm:ss 'GMT'"]


def date_texts_epoch(spark, d):
    """Order dates in several notations, read back as epoch milliseconds; one in eight is no date."""
    text = F.lit("soon")
    moment = F.col("o_orderdate") + F.make_dt_interval(hours=F.pmod("o_orderkey", F.lit(24)).cast("int"))
    for k, form in enumerate(FORMATS):
        text = F.when(F.col("o_orderkey") % 8 == k, F.date_format(moment, form)).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", S.epoch_ms(text).alias("ms"))


# --- what a product page and a comparison show ------------------------------------------------------------------------


def selection_toggled(spark, d):
    """A selection of up to five after one more click."""
    k = F.col("o_orderkey")
    chosen = F.transform(F.slice(F.array(*map(F.lit, range(5))), 1, (k % 6).cast("int")), lambda x: (x + k) % 7)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(catalog.toggled(chosen, F.col("o_custkey") % 7).cast("array<string>"), ",").alias("chosen"))


def product_topics(spark, d):
    """The first two topics of each product's points, and the text about its drawbacks."""
    words = F.split("p_name", " ")
    points = F.when(F.col("p_partkey") % 6 != 0, F.transform(words, lambda w: F.struct(w.alias("topic"), F.length(w).alias("n"))))
    negatives = F.when(F.col("p_partkey") % 4 == 0, F.slice(words, 1, 2)).when(F.col("p_partkey") % 4 == 1, F.array().cast("array<string>"))
    cautions = F.when(F.col("p_partkey") % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.array_join(catalog.top_topics(points, 2), "|").alias("topics"), catalog.drawback_text(negatives, cautions, "none known").alias("drawbacks"))


def saved_products(spark, d):
    """A page of products in which those saved meanwhile stand in their new version."""
    rows = _registered(spark, d).select("id", "product_name", "review_analysis")
    saved = rows.filter("id % 12 = 0").select("id", F.upper("product_name").alias("product_name"), F.lit(None).cast("string").alias("review_analysis"))
    return catalog.replaced(rows, saved)


def review_prompts(spark, d):
    """The instruction for an analysis of each document's lines, as its length and digest."""
    prompt = X.review_prompt(F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("none")), F.slice(reviews.distinct_reviews(F.col("text")), 1, 3), list(CRITERION_LABELS))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(prompt).alias("n"), F.md5(prompt).alias("digest"))


# --- what else comes in, and what goes out ----------------------------------------------------------------------------

#: Captured request bodies by event_id modulo 4, one of them a form; %k stands for the event's own value.
CAPTURED = ['{"checkoutMerchantNo": %k, "originProductNo": "7%k"}', "checkoutMerchantNo=%k&originProductNo=7%k+x&originProductNo=1&page", "[%k]", "no body %k"]


def captured_bodies(spark, d):
    """The numbers that captured request bodies name, of objects and of forms."""
    body = X.captured_body(catalogue.filled(CAPTURED, F.col("event_id"), F.get_json_object("props", "$.k")))
    named = lambda name: F.try_variant_get(body, f"$.{name}", "string")
    return table(spark, d, "events").select("event_id", named("checkoutMerchantNo").alias("merchant"), named("originProductNo").alias("origin"), named("page").alias("page"))


#: Weights as requests send them, by event_id modulo 3.
SENT = ['{"noise": %k, "value": "%k", "drainage": null, "portability": "", "durability_service": true, "installation": "x", "cooling_capacity": 1.%k, "power": [1]}', "[%k]", '{"noise": "-%k", "value": " 7.5 "}']


def request_weights(spark, d):
    """The weights of requests, as they are and as whole numbers."""
    weights = X.coerced_weights(catalogue.filled(SENT, F.col("event_id"), F.get_json_object("props", "$.k")))
    each = table(spark, d, "events").select("event_id", F.explode(weights).alias("key", "weight"))
    return each.select("event_id", "key", "weight", S.weight(F.col("weight"), whole=True).alias("whole"))


def response_statuses(spark, d):
    """What each request for a collection is answered with: it is rejected, its product is unknown or not the only one, or all is well."""
    asked = request_bodies(spark, d).withColumn("origin", F.col("origin_no"))
    have = table(spark, d, "part").filter("p_partkey % 4 < 2").select(F.expr("p_partkey div 3").alias("origin_product_no"))
    return requests.responded(asked, have, "origin", "origin_product_no").select("event_id", "status")


def url_page_numbers(spark, d):
    """The page that a URL asks for, 3 where it names none or 0; and whether it is a review page."""
    page = S.or_default(S.to_number(F.try_element_at(X.parameters(F.col("url")), F.lit("page"))), 3.0)
    return table(spark, d, "pages").select("page_id", page.alias("page"), S.contains_any(F.col("url"), ("/fr/", "ref=")).alias("review_page"))


def static_product_files(spark, d):
    """Products in files of a JSON array each, a thousand a file, read back."""
    at = new_path(spark, "static")
    own = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    files = own.groupBy(F.expr("id div 1000").alias("file")).agg(F.to_json(F.collect_list(F.struct("id", "name", "brand", "category", "price"))).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return static_products(spark, at).select("id", "name", "brand", "category", "price")


def saved_analysis(spark, d):
    """The registry after one product's analysis has been saved."""
    return _shown(catalog.update(_registered(spark, d), 12, F.lit(NOW).cast("timestamp"), review_analysis='{"criterionScores": {"noise": 72}}'))


def compared_products(spark, d):
    """The products of each brand that are compared first."""
    return catalog.compared(catalogue.facts(spark, d).filter("id % 7 < 2"), "brand", *catalog.sort_order("confidence"))


def counted(prompt: str) -> str:
    """A stand-in for a model: how long the prompt is, and how it begins."""
    return f"{len(prompt)} {prompt[:12]}"


def answered_prompts(spark, d):
    """A model's answers to texts; none to blank ones."""
    prompt = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n")).when(F.col("doc_id") % 5 > 1, F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.answered(prompt, counted).alias("answer"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "register_outcomes": register_outcomes, "register_keeps_analysis": register_keeps_analysis, "insert_outcomes": insert_outcomes, "registry_versions": registry_versions,
        "stream_review_collection": stream_review_collection, "stream_messages_once": stream_messages_once, "stream_events_once": stream_events_once, "stream_analyses": stream_analyses,
        "request_bodies": request_bodies, "lookup_profiles": lookup_profiles, "date_texts_epoch": date_texts_epoch,
        "selection_toggled": selection_toggled, "product_topics": product_topics, "saved_products": saved_products, "review_prompts": review_prompts,
        "captured_bodies": captured_bodies, "request_weights": request_weights, "response_statuses": response_statuses, "url_page_numbers": url_page_numbers, "static_product_files": static_product_files,
        "saved_analysis": saved_analysis, "compared_products": compared_products, "answered_prompts": answered_prompts,
    }


# --- SQL --------------------------------------------------------------------------------------------------------------

_SHOP = "'https://shop.example.com/'"
#: e: registered; i: incoming; hk: rows of e that i equals in a key; a: rows of i that are not decided by these; f: the earlier of a that has a value.
_SIDES = f"""e AS (SELECT p_partkey AS id, p_type AS category, p_name AS product_name, {_SHOP} || p_partkey AS source_url, p_partkey // 2 AS origin_product_no,
  CASE WHEN p_partkey % 8 = 0 THEN '{{"n": ' || p_partkey || '}}' END AS review_analysis, '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at FROM part WHERE p_partkey % 4 = 0),
i AS (SELECT p_partkey + 10000000000 AS id, 'CAT' AS category, p_name || ' (new)' AS product_name, {_SHOP} || CASE WHEN p_partkey % 9 = 0 THEN 'x' || (p_partkey // 27) WHEN p_partkey % 12 = 3 THEN (p_partkey + 1)::VARCHAR ELSE 'n' || p_partkey END AS source_url,
  CASE WHEN p_partkey % 9 <> 0 THEN p_partkey // 12 * 6 END AS origin_product_no FROM part WHERE p_partkey % 3 = 0),
hk AS (SELECT i.id, e.id AS old, 'origin_product_no' AS key FROM i JOIN e USING (origin_product_no) UNION ALL SELECT i.id, e.id, 'source_url' FROM i JOIN e USING (source_url))"""
_AMONG = """f AS (SELECT id, min({'w': w, 'k': k}) AS m FROM (SELECT x.id, y.id AS w, 0 AS k FROM a x JOIN a y ON x.origin_product_no = y.origin_product_no AND y.id < x.id
  UNION ALL SELECT x.id, y.id, 1 FROM a x JOIN a y ON x.source_url = y.source_url AND y.id < x.id) GROUP BY id)"""
_KEY = "CASE f.m.k WHEN 0 THEN 'origin_product_no' WHEN 1 THEN 'source_url' END"
_REGISTER = f"""{_SIDES}, h AS (SELECT id, min(old) AS old, max({{'old': old, 'key': key}}) AS high FROM hk GROUP BY id),
t AS (SELECT id, old, max(id) OVER (PARTITION BY old) AS last FROM h WHERE old = high.old),
a AS (SELECT i.*, t.old FROM i LEFT JOIN t USING (id) WHERE CASE WHEN t.id IS NULL THEN i.id NOT IN (SELECT id FROM h) ELSE t.id = t.last END), {_AMONG},
ch AS (SELECT id, 'conflict' AS outcome, high.old AS registry_id, high.key AS clash_key FROM h WHERE old <> high.old
  UNION ALL SELECT id, 'superseded', old, NULL FROM t WHERE id <> last
  UNION ALL SELECT a.id, CASE WHEN f.id IS NOT NULL THEN 'conflict' WHEN a.old IS NULL THEN 'created' ELSE 'updated' END, coalesce(w.old, f.m.w, a.old, a.id), {_KEY} FROM a LEFT JOIN f ON a.id = f.id LEFT JOIN a w ON w.id = f.m.w),
r AS (SELECT e.id, coalesce(i.category, e.category) AS category, coalesce(i.product_name, e.product_name) AS product_name, coalesce(i.source_url, e.source_url) AS source_url,
    CASE WHEN i.id IS NULL THEN e.origin_product_no ELSE i.origin_product_no END AS origin_product_no, review_analysis, created_at, CASE WHEN i.id IS NULL THEN updated_at ELSE '{NOW}' END AS updated_at
  FROM e LEFT JOIN ch ON ch.registry_id = e.id AND ch.outcome = 'updated' LEFT JOIN i ON i.id = ch.id
  UNION ALL SELECT i.id, i.category, i.product_name, i.source_url, i.origin_product_no, NULL, '{NOW}', NULL FROM i JOIN ch USING (id) WHERE outcome = 'created')"""


def oracle_sql() -> dict[str, str]:
    known = catalogue.oracle_sql()
    bodies = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN replace('{b}', '%k', props ->> '$.k')" for k, b in enumerate(BODIES)) + " END"
    number = lambda c: f"CASE json_type(body, '$.{c}') WHEN 'VARCHAR' THEN TRY_CAST(body ->> '$.{c}' AS DOUBLE) WHEN 'BOOLEAN' THEN (body ->> '$.{c}')::BOOLEAN::INTEGER::DOUBLE WHEN 'NULL' THEN 0 ELSE TRY_CAST(body ->> '$.{c}' AS DOUBLE) END"
    sound = "CASE WHEN rejected IS NULL THEN {} END"
    moment = "o_orderdate::TIMESTAMP + to_hours((o_orderkey % 24)::INTEGER)"
    day = f"date_trunc('day', {moment})"
    rules = "Use the reviews alone. Give each criterion a score of 0 to 100, or null where they do not tell: " + ", ".join(CRITERION_LABELS) + ". Answer in JSON."
    own = {
        "captured_bodies": """WITH e AS (SELECT event_id, props ->> '$.k' AS k FROM events)
  SELECT event_id, CASE WHEN event_id % 4 < 2 THEN k END AS merchant, CASE event_id % 4 WHEN 0 THEN '7' || k WHEN 1 THEN '7' || k || ' x' END AS origin, CASE WHEN event_id % 4 = 1 AND k IS NOT NULL THEN '' END AS page FROM e""",
        "request_weights": f"""WITH e AS (SELECT event_id, ({catalogue._filled_sql(SENT, "event_id", "props ->> '$.k'")})::JSON AS j FROM events), k AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM e WHERE json_type(j) = 'OBJECT'),
  v AS (SELECT event_id, key, json_type(j, '$.' || key) AS kind, j ->> ('$.' || key) AS x FROM k),
  w AS (SELECT event_id, key, CASE kind WHEN 'NULL' THEN 0.0 WHEN 'BOOLEAN' THEN (x = 'true')::INTEGER::DOUBLE WHEN 'VARCHAR' THEN CASE WHEN trim(x) = '' THEN 0.0 ELSE try_cast(trim(x) AS DOUBLE) END WHEN 'ARRAY' THEN NULL ELSE x::DOUBLE END AS x FROM v)
  SELECT event_id, key, greatest(0.0, least(10.0, x))::DOUBLE AS weight, greatest(0.0, least(10.0, floor(greatest(0.0, least(10.0, x)) + 0.5)))::DOUBLE AS whole FROM w WHERE x IS NOT NULL""",
        "url_page_numbers": "SELECT page_id, coalesce(nullif(try_cast(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS DOUBLE), 0), 3.0)::DOUBLE AS page, contains(url, '/fr/') OR contains(url, 'ref=') AS review_page FROM pages",
        "static_product_files": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS price FROM part",
        "saved_analysis": f"""WITH {_SIDES} SELECT * REPLACE (CASE WHEN id = 12 THEN '{{"criterionScores": {{"noise": 72}}}}' ELSE review_analysis END AS review_analysis, CASE WHEN id = 12 THEN '{NOW}' ELSE updated_at END AS updated_at) FROM e""",
        "compared_products": f"""WITH {catalogue.PF}, r AS (SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY coalesce(confidence, -1) DESC, id) AS n FROM pf WHERE id % 7 < 2 QUALIFY n <= 5)
  SELECT brand, string_agg(id, ',' ORDER BY n) AS ids FROM r GROUP BY brand HAVING count(*) >= 2""",
        "answered_prompts": "SELECT doc_id, CASE WHEN doc_id % 5 > 1 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN length(text) || ' ' || left(text, 12) END AS answer FROM documents",
        "selection_toggled": """WITH s AS (SELECT o_orderkey, o_custkey % 7 AS v, list_transform(range(o_orderkey % 6), lambda x: (x + o_orderkey) % 7) AS s FROM orders)
  SELECT o_orderkey, array_to_string(CASE WHEN list_contains(s, v) THEN list_filter(s, lambda x: x <> v) WHEN len(s) < 5 THEN list_append(s, v) ELSE s END, ',') AS chosen FROM s""",
        "product_topics": """WITH w AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
  SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN array_to_string(w[1:2], '|') ELSE '' END AS topics,
    coalesce(CASE WHEN p_partkey % 4 = 0 THEN nullif(array_to_string(w[1:2], ' · '), '') END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, 'none known') AS drawbacks FROM w""",
        "saved_products": f"WITH {_SIDES} SELECT id, CASE WHEN id % 12 = 0 THEN upper(product_name) ELSE product_name END AS product_name, CASE WHEN id % 12 <> 0 THEN review_analysis END AS review_analysis FROM e",
        "review_prompts": f"""WITH l AS (SELECT doc_id, coalesce(lang, 'none') AS lang, unnest(list_prepend(NULL, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))) AS raw, generate_subscripts(list_prepend(NULL, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), 1) AS i FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, lang, {catalogue._collapse("raw")} AS r, min(i) AS i FROM l GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r IS NULL OR r = '', i) AS n FROM c),
  p AS (SELECT doc_id, 'Product: ' || doc_id || chr(10) || 'Category: ' || any_value(lang) || chr(10) || '{rules}' || chr(10) || chr(10) || 'Reviews:' || chr(10) || coalesce(string_agg(n || '. ' || r, chr(10) ORDER BY n) FILTER (r <> '' AND n <= 3), '') AS p FROM k GROUP BY doc_id)
  SELECT doc_id, length(p)::INTEGER AS n, md5(p) AS digest FROM p""",
        "register_outcomes": f"WITH {_REGISTER} SELECT * FROM ch", "register_keeps_analysis": f"WITH {_REGISTER} SELECT * FROM r",
        "insert_outcomes": f"""WITH {_SIDES}, h AS (SELECT id, min({{'w': old, 'k': key}}) AS m FROM hk GROUP BY id), a AS (SELECT * FROM i WHERE id NOT IN (SELECT id FROM h)), {_AMONG}
  SELECT id, 'conflict' AS outcome, m.w AS registry_id, m.k AS clash_key FROM h UNION ALL SELECT a.id, CASE WHEN f.id IS NULL THEN 'created' ELSE 'conflict' END, coalesce(f.m.w, a.id), {_KEY} FROM a LEFT JOIN f ON a.id = f.id""",
        "registry_versions": f"WITH {_REGISTER} SELECT *, 1::INTEGER AS version FROM e UNION ALL BY NAME SELECT *, 2::INTEGER AS version FROM r UNION ALL BY NAME SELECT *, 3::INTEGER AS version FROM r WHERE id % 5 <> 0",
        "stream_review_collection": known["review_collection"], "stream_messages_once": known["review_messages_once"], "stream_analyses": known["review_analysis_stub"],
        "stream_events_once": "SELECT DISTINCT event_id, event_type, value FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)",
        "request_bodies": f"""WITH b AS (SELECT event_id, {bodies} AS raw FROM events), v AS (SELECT event_id, CASE WHEN json_valid(raw) THEN raw END AS body FROM b),
  n AS (SELECT *, {number("checkoutMerchantNo")} AS m, {number("originProductNo")} AS o, CASE WHEN coalesce(json_type(body, '$.maxReviews'), 'NULL') = 'NULL' THEN 20 ELSE {number("maxReviews")} END AS x FROM v),
  r AS (SELECT *, CASE WHEN coalesce(json_type(body), '') <> 'OBJECT' THEN 'body' WHEN NOT coalesce(m = floor(m) AND m > 0, false) THEN 'checkoutMerchantNo' WHEN NOT coalesce(o = floor(o) AND o > 0, false) THEN 'originProductNo' END AS rejected FROM n)
  SELECT event_id, {sound.format("m::BIGINT")} AS merchant_no, {sound.format("o::BIGINT")} AS origin_no, {sound.format("least(100, greatest(1, coalesce(floor(x), 20)))::INTEGER")} AS max_reviews, rejected FROM r""",
        "lookup_profiles": "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "date_texts_epoch": f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 3 THEN epoch_ms({moment}) - 9 * 3600000 WHEN 0 THEN epoch_ms({day}) WHEN 4 THEN epoch_ms({day}) WHEN 5 THEN epoch_ms({day}) ELSE epoch_ms({moment}) END AS ms FROM orders",
    }
    own["response_statuses"] = f"""WITH q AS ({own["request_bodies"]}), h AS (SELECT p_partkey // 3 AS origin_no, count(*) AS n FROM part WHERE p_partkey % 4 < 2 GROUP BY ALL)
  SELECT event_id, CASE WHEN rejected IS NOT NULL THEN 400 WHEN n IS NULL THEN 404 WHEN n > 1 THEN 409 ELSE 200 END AS status FROM q LEFT JOIN h USING (origin_no)"""
    return own
