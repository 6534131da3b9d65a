"""Links and blocks of raw pages as rows, by patterns; scripts and styles go first, as they may hold tags in strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r'<a href="([^"]*)"'
BLOCK = r"(?s)<p>(.*?)</p>"


def link_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href), pos from 1."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("pos", "href")).withColumn("pos", F.col("pos") + 1)


def block_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, block), pos from 0."""
    clean = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(BLOCK), 1)).alias("pos", "block"))


def index_links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, slug, pos): first places of the slugs, group 1 of ``pattern``, which a link must match as a whole."""
    links = link_rows(pages).select("page_id", "pos", F.regexp_extract("href", f"^(?:{pattern})$", 1).alias("slug")).filter("slug <> ''")
    return links.groupBy("page_id", "slug").agg(F.min("pos").alias("pos"))
