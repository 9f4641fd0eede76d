"""Product information from HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions.scalars import BLOCK_MARKERS, allowed_url, contains_any, meta_content, page_title, product_name, title_text, trim

#: What tells a product page.
PRODUCT_MARKERS = ("product", "상품", "리뷰")


def allowed(pages: DataFrame, hosts: list[str], subdomains: bool = True) -> DataFrame:
    """The pages whose https URL is on one of these hosts (or below one): the others are not fetched."""
    return pages.filter(allowed_url(F.col("url"), hosts, subdomains))


def refused(html: Column, status: Column | None = None) -> Column:
    """Whether a page is no answer: by its words, or by a status that is not in the 200s (a null one tells nothing)."""
    said = contains_any(html, BLOCK_MARKERS)
    return said if status is None else said | F.coalesce(~status.between(200, 299), F.lit(False))


def product_info(pages: DataFrame, status: Column | None = None) -> DataFrame:
    """page_id, product_name, title, description, image, blocked: nothing is read from a page that refuses."""
    html = F.col("html")
    title = F.coalesce(meta_content(html, "property", "og:title"), meta_content(html, "name", "twitter:title"), page_title(html))
    description = F.coalesce(meta_content(html, "property", "og:description"), meta_content(html, "name", "description"))
    found = pages.select("page_id", refused(html, status).alias("blocked"), title.alias("title"), description.alias("description"), meta_content(html, "property", "og:image").alias("image"))
    shown = lambda c: F.when(~F.col("blocked"), c)
    return found.select("page_id", shown(product_name(F.col("title"))).alias("product_name"), shown(F.col("title")).alias("title"), shown(F.col("description")).alias("description"), shown(F.col("image")).alias("image"), "blocked")


def probe(pages: DataFrame, markers: tuple[str, ...] = PRODUCT_MARKERS) -> DataFrame:
    """page_id, html_length, has_marker, title."""
    return pages.select("page_id", F.length("html").cast("long").alias("html_length"), contains_any(F.col("html"), markers).alias("has_marker"), trim(title_text(F.col("html"))).alias("title"))
