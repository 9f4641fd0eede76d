"""Registration of products with the outcome of every incoming row.

insert() and register() return the registry afterwards and a relation of changes: a row for each incoming row with what became
of it and which registry row that concerns. Incoming rows count in the order of their ids, as requests would arrive; null key
values are equal to nothing. Keys are compared by equi joins, one for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.sources.scratch import written

KEYS = ("origin_product_no", "source_url")
#: What registering a known product again changes; all else stays as it is.
UPDATED = ("category", "product_name", "name", "source_url", "checkout_merchant_no", "origin_product_no")
CHANGES = ["id", "outcome", "registry_id", "clash_key"]


def admitted(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """id, registry_id, clash_key: for each row the row that holds its key values once all have come in turn: its own id if it
    shares none with an admitted row before it, else the smallest id of those, and the first key that it shares with it.

    A round admits the rows that are first for all their values and turns away those that share one with them; rows that
    were only behind rows turned away go on. Rounds are as many as such chains are long, mostly one or two."""
    left, done = rows.select("id", *keys), None
    while True:
        at = left
        for key in keys:
            least = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(f"_{key}"))
            at = at.join(least, key, "left")
        first = reduce(Column.__and__, (F.col(key).isNull() | (F.col("id") == F.col(f"_{key}")) for key in keys))
        at = written(at.withColumn("_first", first).select("id", *keys, "_first"), "admitted")
        decided = written(known(at.filter("not _first"), at.filter("_first"), keys).unionByName(at.filter("_first").select("id", F.col("id").alias("registry_id"), F.lit(None).cast("string").alias("clash_key"))), "decided")
        done = decided if done is None else done.unionByName(decided)
        left = at.join(decided, "id", "left_anti").select("id", *keys)
        if left.isEmpty():
            return done


def known(rows: DataFrame, others: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """id, registry_id, clash_key: for rows that share a key value with others, the smallest id of these and the first key."""
    found = None
    for at, key in enumerate(keys):
        least = others.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("registry_id"))
        hit = rows.select("id", key).join(least, key).select("id", F.struct("registry_id", F.lit(at).alias("at"), F.lit(key).alias("clash_key")).alias("hit"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("id").agg(F.min("hit").alias("hit")).select("id", "hit.registry_id", "hit.clash_key")


def _new_rows(registry: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Rows as the registry holds them: what an insert does not give is null, created_at is now."""
    given = {c for c in rows.columns if c in (*UPDATED, "id")}
    value = lambda f: F.col(f.name) if f.name in given else now if f.name == "created_at" else F.lit(None)
    return rows.select(*(value(f).cast(f.dataType).alias(f.name) for f in registry.schema))


def insert(registry: DataFrame, incoming: DataFrame, now: Column, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(registry afterwards, changes): outcome created, or conflict with the registry row (old or just created) that has one of the
    row's key values. A conflict changes nothing."""
    clash = written(known(incoming, registry, ("id", *keys)), "clash")
    fresh = admitted(incoming.join(clash, "id", "left_anti"), keys)
    changes = written(clash.unionByName(fresh).select("id", F.when(F.col("clash_key").isNull(), "created").otherwise("conflict").alias("outcome"), "registry_id", "clash_key"), "changes")
    created = incoming.join(changes.filter("outcome = 'created'").select("id"), "id", "left_semi")
    return registry.unionByName(_new_rows(registry, created, now)), changes


def register(registry: DataFrame, incoming: DataFrame, now: Column, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(registry afterwards, changes): a row that equals a registry row in a key updates it: the columns of UPDATED and updated_at
    alone, so its id, analysis, scores and created_at stay. Others are created.

    outcome: created; updated; superseded by a later row for the same registry row; conflict with another registry row: where the
    row equals several, or where its new key values are taken by a row of this batch before it. Values that an update frees
    are not free within the batch."""
    sides = []
    for key in keys:
        old = registry.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("old"))
        sides.append(incoming.select("id", key).join(old, key).select("id", "old", F.lit(key).alias("key")))
    each = reduce(DataFrame.unionByName, sides).groupBy("id").agg(F.min(F.struct("old", "key")).alias("low"), F.max(F.struct("old", "key")).alias("high"))
    hits = written(each.select("id", F.col("low.old").alias("registry_id"), F.when(F.col("low.old") != F.col("high.old"), F.col("high")).alias("other")), "hits")
    several = hits.filter("other is not null").select("id", F.lit("conflict").alias("outcome"), F.col("other.old").alias("registry_id"), F.col("other.key").alias("clash_key"))
    one = hits.filter("other is null").select("id", "registry_id")
    last = one.groupBy("registry_id").agg(F.max("id").alias("last"))
    one = written(one.join(last, "registry_id"), "targets")
    none = F.lit(None).cast("string").alias("clash_key")
    superseded = one.filter("id <> last").select("id", F.lit("superseded").alias("outcome"), "registry_id", none)
    target = one.filter("id = last").select("id", F.col("registry_id").alias("target"))
    # a new row whose id the registry has is turned away, too
    fresh = incoming.join(hits.select("id"), "id", "left_anti")
    same_id = written(known(fresh, registry, ("id",)), "same-id")
    open_rows = incoming.join(target.select("id").unionByName(fresh.select("id")), "id", "left_semi").join(same_id, "id", "left_anti")
    # the row that holds the values stands for the registry row that it updates
    held = admitted(open_rows, keys).join(target.withColumnRenamed("id", "registry_id"), "registry_id", "left")
    outcome = F.when(F.col("clash_key").isNotNull(), "conflict").when(F.col("target").isNull(), "created").otherwise("updated")
    settled = held.select("id", outcome.alias("outcome"), F.coalesce("target", "registry_id").alias("registry_id"), "clash_key")
    refused = same_id.select("id", F.lit("conflict").alias("outcome"), "registry_id", "clash_key")
    changes = written(reduce(DataFrame.unionByName, [several, superseded, refused, settled]).select(CHANGES), "changes")

    columns = [c for c in UPDATED if c in registry.columns and c in incoming.columns]
    new = incoming.join(changes.filter("outcome = 'updated'").select("id", "registry_id"), "id").select(F.col("registry_id").alias("id"), F.struct(*columns).alias("_new"))
    stamped = {"updated_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at"))} if "updated_at" in registry.columns else {}
    after = registry.join(new, "id", "left")
    after = after.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns} | stamped).select(registry.columns)
    created = incoming.join(changes.filter("outcome = 'created'").select("id"), "id", "left_semi")
    return after.unionByName(_new_rows(registry, created, now)), changes
