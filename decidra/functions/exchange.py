"""Values that travel as text: request parameters, transfers between pages, captured request bodies, prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from decidra.functions.scalars import clamp, collapse, host, json_coerced, json_number, protocol, to_number, url_text


def parameters(url: Column) -> Column:
    """The query parameters of a URL, decoded, as a map; the first of equal names counts, a bare name is empty."""
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    part = lambda p, k: F.coalesce(F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), k), F.lit(""))), F.lit(""))
    entries = F.transform(pairs, lambda p: F.struct(part(p, 0).alias("key"), part(p, 1).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.get(F.filter(entries, lambda e: e["key"] == n), 0)["value"].alias("value"))))


def link(path: str, **values: Column) -> Column:
    """A path with these parameters, encoded; those that are null are left out."""
    given = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), url_text(v))) for name, v in values.items())))
    return F.when(F.size(given) == 0, F.lit(path)).otherwise(F.concat(F.lit(f"{path}?"), F.array_join(given, "&")))


def origin_and_path(url: Column) -> Column:
    """Scheme, host and path of a URL."""
    return F.concat(protocol(url), F.lit("://"), host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def review_path(url: Column, paths: dict[str, str]) -> Column:
    """The review feed's path for the URL's host, null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, path in paths.items():
        out = F.when(host(url) == name, F.lit(path)).otherwise(out)
    return out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def captured_body(text: Column) -> Column:
    """A request body as a variant object: JSON, or a form's parameters; null if it is neither."""
    parsed = F.try_parse_json(text)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    form = F.try_parse_json(F.to_json(parameters(F.concat(F.lit("?"), text))))
    return F.when(is_object, parsed).when(text.contains("="), form)


def transfer(text: Column, tag: str, product: Column) -> Column:
    """The reviews of a page-to-page message: collapsed, each once, at most 100. Null if its type is not `tag` or it is
    about another product."""
    v = F.try_parse_json(text)
    mine = (F.try_variant_get(v, "$.type", "string") == tag) & (F.try_variant_get(v, "$.productId", "string") == product)
    raw = F.when(F.schema_of_variant(F.try_variant_get(v, "$.reviews", "variant")).startswith("ARRAY"), F.try_variant_get(v, "$.reviews", "array<variant>"))
    texts = F.transform(F.filter(raw, lambda r: F.schema_of_variant(r) == "STRING"), lambda r: collapse(F.try_variant_get(r, "$", "string")))
    return F.when(mine, F.slice(F.array_distinct(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t != "")), 1, 100))


def transfer_message(tag: str | Column, product: Column, reviews: Column, **about: Column) -> Column:
    """The message that transfer() reads: at most 100 reviews, and what is known about their source. Null without reviews."""
    few = F.slice(reviews, 1, 100)
    body = F.struct(F.lit(tag).alias("type"), product.cast("string").alias("productId"), *(v.alias(name) for name, v in about.items()), few.alias("reviews"))
    return F.when(F.size(few) > 0, F.to_json(body))


def session_text(category: Column, use_case: Column, answers: Column, weights: Column) -> Column:
    """What a visitor's session keeps: answers and weights are maps; what is null is left out."""
    return F.to_json(F.struct(category.alias("category"), use_case.alias("useCase"), answers.alias("answers"), weights.alias("weights")))


def number_weights(text: Column, path: str = "$") -> Column:
    """The weights of a JSON object (at a path of the text) that are numbers, within 0 to 10, as a map. Numeric texts and other
    values are left out; the map is empty for null and where there is no object."""
    v = F.try_variant_get(F.try_parse_json(text), path, "variant")
    own = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    given = F.map_filter(F.transform_values(own, lambda _, x: json_number(x)), lambda _, x: x.isNotNull())
    return F.coalesce(F.transform_values(given, lambda _, x: clamp(x, high=10.0)), F.create_map().cast("map<string,double>"))


def coerced_weights(text: Column, path: str = "$") -> Column:
    """The same with every value read as a number: texts that are such, true as 1, null and blank texts as 0; the rest is left out."""
    v = F.try_variant_get(F.try_parse_json(text), path, "variant")
    own = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    read = F.map_filter(F.transform_values(own, lambda _, x: json_coerced(x)), lambda _, x: ~F.isnan(x))
    return F.coalesce(F.transform_values(read, lambda _, x: clamp(x, high=10.0)), F.create_map().cast("map<string,double>"))


def selection(ids: list, least: int = 2, most: int = 5) -> list:
    """The selected ids. ValueError unless there are 2 to 5."""
    if not least <= len(ids) <= most:
        raise ValueError(f"{least} to {most} products can be compared, not {len(ids)}")
    return ids


def numbers(text: Column) -> Column:
    """A comma-separated list as numbers; what is no number is null."""
    return F.transform(F.split(text, ","), to_number)


def review_prompt(product: Column, category: Column, reviews: Column, criteria: list[str]) -> Column:
    """The instruction for an analysis of reviews: they are numbered from 1, scores are 0 to 100 or null."""
    numbered = F.array_join(F.transform(reviews, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    rules = "Use the reviews alone. Give each criterion a score of 0 to 100, or null where they do not tell: " + ", ".join(criteria) + ". Answer in JSON."
    return F.concat(F.lit("Product: "), product, F.lit("\nCategory: "), category, F.lit(f"\n{rules}\n\nReviews:\n"), numbered)


def answered(prompt: Column, model: Callable[[str], str]) -> Column:
    """A model's answers to prompts, in Arrow batches; null for an empty prompt."""

    @F.pandas_udf(StringType())
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: model(p) if p and p.strip() else None)

    return ask(prompt)
