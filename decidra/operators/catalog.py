"""Catalogue search, sorting, lookups, and registry maintenance by copy on write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.scalars import matches
from decidra.operators.recommend import with_rank
from decidra.operators.registry import UPDATED


def search(products: DataFrame, query: str = "", analyzed_only: bool = False, columns: tuple[str, ...] = ("name", "category")) -> DataFrame:
    """Products of which a column contains the query; with a review analysis only, if asked for."""
    found = products.filter(matches(query, *map(F.col, columns)))
    return found.filter(F.col("review_analysis").isNotNull()) if analyzed_only else found


def sort_order(kind: str, confidence: Column | None = None, analyzed: Column | None = None) -> list[Column]:
    """The order of a catalogue page; ties by id."""
    confidence = F.coalesce(F.col("confidence") if confidence is None else confidence, F.lit(-1))
    analyzed = F.col("review_analysis").isNotNull() if analyzed is None else analyzed
    return {
        "analysis": [analyzed.desc(), confidence.desc()], "confidence": [confidence.desc()], "newest": [F.col("updated_at").desc_nulls_last()],
        "name": [F.collate(F.col("name"), "ko").asc()], "created": [F.col("created_at").desc_nulls_first()],
    }[kind] + [F.col("id").asc()]


def page(products: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    """The first products in this order: a bounded heap per task and one merge."""
    return products.orderBy(*sort_order(kind)).limit(limit)


def by_ids(products: DataFrame, ids: list) -> DataFrame:
    """The products with these ids; an empty list gives all."""
    return products.filter(F.col("id").isin(*ids)) if ids else products


def pick(products: DataFrame, wanted) -> DataFrame:
    """The product with this id, else the first one, else none."""
    return products.orderBy((F.col("id") == F.lit(wanted)).desc_nulls_last(), "id").limit(1)


def single(df: DataFrame, required: bool = True):
    """The only row. ValueError if there is none (and one is required) or more than one."""
    rows = df.limit(2).collect()
    if len(rows) > 1 or required and not rows:
        raise ValueError(f"{'one row' if required else 'one row at most'} expected, found {'several' if rows else 'none'}")
    return rows[0] if rows else None


def collection_ready() -> Column:
    """Whether both numbers that review collection needs are there and not zero."""
    return (F.coalesce("checkout_merchant_no", F.lit(0)) != 0) & (F.coalesce("origin_product_no", F.lit(0)) != 0)


def top_topics(points: Column, k: int) -> Column:
    """The topics of the first k points (structs); none for null."""
    return F.coalesce(F.slice(F.transform(points, lambda p: p["topic"]), 1, k), F.array().cast("array<string>"))


def drawback_text(negatives: Column, cautions: Column, text: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(negatives, " · "), F.lit("")), F.get(cautions, 0), F.lit(text))


def toggled(selection: Column, value: Column, most: int = 5) -> Column:
    """Without the value if it is selected, else with it while there is room."""
    return F.when(F.array_contains(selection, value), F.array_remove(selection, value)).when(F.size(selection) < most, F.array_append(selection, value)).otherwise(selection)


def compared(products: DataFrame, by: str, *order: Column, least: int = 2, most: int = 5) -> DataFrame:
    """by, ids: the first ids of each group in this order, joined, for a comparison; groups with fewer than two have none.

    Rows are cut to `most` a group in each task before the shuffle, so a group is bounded."""
    first = with_rank(products, *order, by=(by,)).filter(F.col("rank") <= most)
    ids = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))).alias("_ids")).filter(F.size("_ids") >= least)
    return ids.select(by, F.array_join(F.transform("_ids", lambda x: x["id"]), ",").alias("ids"))


# --- registry


def matching(new: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("origin_product_no", "source_url")) -> DataFrame:
    """The new rows that an existing row equals in one of the keys: an equi join for each key, not one join on an OR."""
    out = None
    for key in keys:
        hit = new.join(existing.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select(new.columns)
        out = hit if out is None else out.unionByName(hit)
    return out.dropDuplicates(["id"])


def duplicates(products: DataFrame, key: str = "origin_product_no") -> DataFrame:
    """(id, other_id): other products with the same key value."""
    other = products.select(F.col("id").alias("other_id"), key)
    return products.select("id", key).join(other, key).filter(F.col("id") != F.col("other_id")).select("id", "other_id")


def shared(products: DataFrame, key: str = "origin_product_no") -> DataFrame:
    """The products whose key value another product has too: ids are compared per value, so no pairs are made."""
    several = products.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return products.join(several, key, "left_semi").select(products.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The registry after incoming rows have replaced those with their key, all columns of them, or joined it."""
    return existing.join(incoming.select(key), key, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def first_of(rows: DataFrame, keys: tuple[str, ...] = ("origin_product_no", "source_url")) -> DataFrame:
    """rows without those that share a key value with a row of a smaller id."""
    for key in keys:
        least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_least"))
        rows = rows.join(least, key, "left").filter(F.col(key).isNull() | (F.col("id") == F.col("_least"))).drop("_least")
    return rows


def insert_new(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("origin_product_no", "source_url")) -> DataFrame:
    """The registry with those incoming rows that clash with none of its rows, nor with an incoming row before them."""
    for key in keys:
        incoming = incoming.join(existing.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
    return first_of(incoming, keys).select(existing.columns).unionByName(existing)


def register(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("origin_product_no", "source_url"), now: Column | None = None) -> DataFrame:
    """The registry after each incoming row has updated the row that it equals in one of the keys, or joined the registry.

    An existing row keeps all but the columns of registry.UPDATED; updated_at becomes now, if given. If an incoming row equals several, the smallest id is updated; if several equal one row, the
    last of them counts. Of new rows that share a key value, the first joins."""
    hits = None
    for key in keys:
        old = existing.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("_old"))
        hit = incoming.select(F.col("id").alias("_new"), key).join(old, key).select("_new", "_old")
        hits = hit if hits is None else hits.union(hit)
    hits = hits.groupBy("_new").agg(F.min("_old").alias("_old"))
    last = hits.groupBy("_old").agg(F.max("_new").alias("_new"))
    others = [c for c in existing.columns if c in UPDATED]
    values = incoming.join(last, F.col("id") == F.col("_new")).select(F.col("_old").alias("id"), F.struct(*others).alias("_values"))
    changed = F.col("_values").isNotNull()
    new_values = {c: F.when(changed, F.col(f"_values.{c}")).otherwise(F.col(c)) for c in others}
    if now is not None:
        new_values["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    updated = existing.join(values, "id", "left").withColumns(new_values).select(existing.columns)
    new = first_of(incoming.join(hits, F.col("id") == F.col("_new"), "left_anti"), keys)
    return updated.unionByName(new.select(updated.columns))


def update(products: DataFrame, wanted, now: Column, **values) -> DataFrame:
    """The registry with these values in the product with this id, and updated_at stamped."""
    own = F.col("id").eqNullSafe(F.lit(wanted))
    return products.withColumns({name: F.when(own, F.lit(v)).otherwise(F.col(name)) for name, v in values.items()} | {"updated_at": F.when(own, now).otherwise(F.col("updated_at"))})


def delete(products: DataFrame, wanted) -> DataFrame:
    return products.filter(~F.col("id").eqNullSafe(F.lit(wanted)))


def replaced(rows: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """Every row, in its saved version where there is one."""
    new = saved.select(F.col(key), F.struct(*rows.columns).alias("_new"))
    return rows.join(new, key, "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns))
