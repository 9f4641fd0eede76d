"""Mixing of sources to target weights, with budgets handed down a tree.

The leaves are (domain, language, source). A token budget enters at the root and is divided among a node's children by
their weights. A child can take no more than its tokens times `epochs`; what it cannot take goes to its siblings by their
weights, and only what no sibling can take reaches the level above (as the parent then takes less of its own budget).
All of it is done in whole numbers, so the result does not depend on partitioning: below the root by windows over the
children of a node, at the root, whose children may be many, by sums over all domains until no more of them fill up.

A leaf that gets more than its tokens is read in whole epochs; of the last, partial one the longest token-prefix within
the budget is taken, in an order seeded by epoch and doc_id. Prefix sums are spread over many tasks per leaf (running()).

Tokens are the words `[^\\x20\\x09-\\x0D]+` of the whole text. A null language or source is a leaf named "" like others. A
null doc_id takes part, first in order. A text without words costs nothing, so it may
stand in the prefix of an epoch that has no tokens left. Weights that are not named are 1; a node of
weight 0, and all below it, gets nothing, and what it holds is no capacity of its parents. Repeated rows count each; rows
that share a doc_id are next to one another in an epoch, in any order. A text longer than its leaf's last part is left out
of it. Columns beyond doc_id, text, lang, source and those in `carry` are not read; columns named like those that are
added (domain, language, origin, tokens, copies) give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.llm.common import cut, plain_text, running, table

LEVELS = ["domain", "language", "origin"]
#: Documents name no domain; as a stand-in, sources are dealt to four.
DOMAINS = 4
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def tokens(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_columns() -> dict[str, F.Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {
        "domain": F.concat(F.lit("d"), F.pmod(F.crc32(source), F.lit(DOMAINS)).cast("string")),
        "language": F.coalesce(F.col("lang").cast("string"), F.lit("")), "origin": source,
    }


def _weight(column: str, weights: dict[str, int]) -> F.Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def divide(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `given`: each node's part of its parent's `budget`, by weight and up to its capacity.

    nodes: the parents' columns, `name`, weight, capacity, budget (the parent's). Children are taken in the order in which
    they fill up; those before the first that does not are full, and the rest share what is left."""
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = nodes.withColumns({"_left": F.col("budget") - before, "_weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "_at": F.row_number().over(order)})
    open_ = _wide("capacity") * _wide("_weights") > _wide("_left") * _wide("weight")
    nodes = nodes.withColumn("_first", F.min(F.when(open_, F.col("_at"))).over(family))
    at_first = F.col("_at") == F.col("_first")
    nodes = nodes.withColumns({"_share": F.max(F.when(at_first, F.col("_left"))).over(family), "_of": F.max(F.when(at_first, F.col("_weights"))).over(family)})
    full = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    given = F.when(full, F.col("capacity")).otherwise(F.expr("cast(_share as decimal(19, 0)) * cast(weight as decimal(18, 0)) div _of"))
    return nodes.withColumn("given", F.coalesce(given, F.lit(0).cast("long"))).drop("_left", "_weights", "_at", "_first", "_share", "_of")


def _wide(column: str) -> F.Column:
    return F.col(column).cast("decimal(19, 0)")


def divide_root(nodes: DataFrame, budget: int) -> DataFrame:
    """divide() for one family of any size: each turn sums what is full at the share of the turn before, which grows."""
    nodes = cut(nodes, "op2-root")
    left, of = budget, nodes.agg(F.sum("weight")).first()[0] or 0
    while True:
        full = _wide("capacity") * F.lit(of).cast("decimal(19, 0)") <= _wide("weight") * F.lit(left).cast("decimal(19, 0)")
        sums = nodes.agg(F.sum(F.when(full, F.col("capacity"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("of")).first()
        if not sums["of"]:
            return nodes.withColumn("given", F.col("capacity"))
        now = budget - (sums["full"] or 0), sums["of"]
        if now == (left, of):
            share = F.expr(f"cast({left} as decimal(19, 0)) * cast(weight as decimal(18, 0)) div cast({of} as bigint)")
            return nodes.withColumn("given", F.when(full, F.col("capacity")).otherwise(share))
        left, of = now


def budgets(leaves: DataFrame, percent: int, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """domain, language, origin, tokens, given, open (no weight of 0 above it) for these leaves (with tokens); the root gets
    `percent` of all tokens."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    open_ = F.lit(True)
    for level in LEVELS:
        open_ = open_ & (_weight(level, weights.get(level, {})) > 0)
    known = leaves.withColumn("open", open_).withColumn("capacity", F.when(F.col("open"), F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        weight = _weight(level, weights.get(level, {}))
        if depth == 0:
            nodes = known.groupBy(level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight)
            given = divide_root(nodes, total * percent // 100)
        else:
            nodes = known.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("budget")).withColumn("weight", weight)
            given = divide(nodes, path[:-1], level)
        known = known.drop("budget").join(given.select(*path, F.col("given").alias("budget")), path)
    return known.select(*LEVELS, "tokens", F.col("budget").alias("given"), "open")


def seeded(seed: int, epoch: F.Column, key: F.Column) -> F.Column:
    """An order of documents that differs by epoch, as a bigint over 0 to 2^63."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 3)


def mix(docs: DataFrame, percent: int = 80, epochs: int = 2, weights: dict[str, dict[str, int]] | None = None, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, language, origin, tokens, copies (and the columns in `carry`) of the rows of docs that are taken."""
    weights = {"domain": DOMAIN_WEIGHTS, "language": LANGUAGE_WEIGHTS} if weights is None else weights
    own = docs.select("doc_id", *carry, *(c.alias(n) for n, c in leaf_columns().items()), tokens(plain_text()).alias("tokens"))
    slim = cut(own, "op2-tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    given = cut(budgets(leaves, percent, epochs, weights), "op2-budgets")
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(1 if epochs else 0)).cast("long")
    plan = given.filter("open").select(*LEVELS, whole.alias("whole"), (F.col("given") - whole * F.col("tokens")).alias("rest"))
    # the epoch of a leaf's prefix is that after its whole ones; the few leaves are broadcast if they are as small as expected
    epoch = slim.join(plan.select(*LEVELS, "whole"), LEVELS)
    placed = running(epoch, LEVELS, seeded(seed, F.col("whole"), F.col("doc_id")), F.col("tokens"), "before", carry=plan.select(*LEVELS, "rest"))
    taken = placed.withColumn("copies", F.col("whole") + (F.col("before") + F.col("tokens") <= F.col("rest")).cast("long"))
    return taken.filter("copies > 0").select("doc_id", *carry, *LEVELS, "tokens", "copies")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(name: str, path: list[str], before: str, after: str, weights: dict[str, int]) -> str:
    parents, keys = ", ".join(path[:-1]) or "0", ", ".join(path)
    weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"
    return f"""
{after}_n AS (SELECT {keys}, sum(capacity)::BIGINT AS capacity, any_value(budget) AS budget, {weight} AS weight FROM {before} GROUP BY {keys}),
{after}_o AS (SELECT *, budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
       sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER o AS pos
  FROM {after}_n WINDOW o AS (PARTITION BY {parents} ORDER BY capacity / weight, {name})),
{after}_f AS (SELECT *, min(CASE WHEN capacity * ws > l * weight THEN pos END) OVER (PARTITION BY {parents}) AS f FROM {after}_o),
{after}_g AS (SELECT {keys}, CASE WHEN f IS NULL OR pos < f THEN capacity ELSE
       (max(CASE WHEN pos = f THEN l END) OVER (PARTITION BY {parents}) * weight) // max(CASE WHEN pos = f THEN ws END) OVER (PARTITION BY {parents}) END AS budget FROM {after}_f),
{after} AS (SELECT b.* EXCLUDE (budget), g.budget::BIGINT AS budget FROM {before} b JOIN {after}_g g USING ({keys}))"""


#: The domain is crc32 of the source, which DuckDB lacks: it is spelled out for the sources of the tables.
def _crc_sql() -> str:
    import zlib

    names = ["", *(f"src{i}" for i in range(20))]
    return "CASE " + " ".join(f"WHEN coalesce(source, '') = '{n}' THEN 'd{zlib.crc32(n.encode()) % DOMAINS}'" for n in names) + " END"


SQL = rf"""
WITH d AS (SELECT doc_id, {_crc_sql()} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
l0 AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens, (2 * sum(tokens))::BIGINT AS capacity,
              floor(sum(sum(tokens)) OVER () * 80 / 100)::BIGINT AS budget FROM d GROUP BY ALL),
{_level_sql("domain", LEVELS[:1], "l0", "l1", DOMAIN_WEIGHTS)},
{_level_sql("language", LEVELS[:2], "l1", "l2", LANGUAGE_WEIGHTS)},
{_level_sql("origin", LEVELS, "l2", "l3", {})},
p AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END * tokens AS rest FROM l3),
r AS (SELECT d.*, whole, rest, sum(d.tokens) OVER (PARTITION BY domain, language, origin ORDER BY substr(md5('17|' || whole || '|' || doc_id), 1, 15)
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN p USING (domain, language, origin))
SELECT doc_id, domain, language, origin, tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
