"""Sources over web pages: links, listings, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html", excluded: tuple[str, ...] = (), same_host: bool = False) -> DataFrame:
    """page, host, href (as written, without fragment) and target (trailing slashes gone) of each anchor, in order (`pos`)."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"#]*)'), F.lit(1))
    out = pages.select(page, F.regexp_extract(url, r"^https?://([^/?#:]+)", 1).alias("host"), F.posexplode(anchors).alias("pos", "href")).filter("href <> ''")
    out = out.withColumn("target", F.regexp_replace("href", "/+$", ""))
    for part in excluded:
        out = out.filter(~F.contains("href", F.lit(part)))
    if same_host:
        other = F.regexp_extract("href", r"^https?://([^/?#:]+)", 1)
        out = out.filter((other == "") | (other == F.col("host")))
    return out


def listed(pages: DataFrame, pattern: str, *, page: str = "page_id", html: str = "html") -> DataFrame:
    """Different slugs (group 1 of an anchor pattern) with the title (group 2) of their first place, in order of sight."""
    slugs = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    titles = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2))
    rows = pages.select(page, F.posexplode(F.arrays_zip(slugs.alias("slug"), titles.alias("title"))).alias("pos", "x")).select(page, "pos", "x.slug", "x.title")
    return rows.groupBy("slug").agg(F.min(F.struct(page, "pos", "title")).alias("first")).select("slug", F.trim(F.regexp_replace("first.title", "<[^>]+>", " ")).alias("title"), F.col(f"first.{page}").alias(page), F.col("first.pos").alias("pos"))


def sitemap(texts: DataFrame, column: str = "value", issue: str = r"/(\d{4})/(\d+)", oldest: int | None = None) -> DataFrame:
    """Addresses of <loc> elements with the year and issue in them, newest first."""
    rows = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc")).distinct()
    rows = rows.select("loc", F.regexp_extract("loc", issue, 1).try_cast("int").alias("year"), F.regexp_extract("loc", issue, 2).try_cast("int").alias("issue")).filter("year is not null")
    if oldest is not None:
        rows = rows.filter(F.col("year") >= oldest)
    return rows.orderBy(F.desc("year"), F.desc("issue"), "loc")


def paged_ids(pages: DataFrame, pattern: str, *, page: str = "page_id", html: str = "html") -> DataFrame:
    """Different ids of numbered result pages in order of appearance."""
    ids = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    rows = pages.select(page, F.posexplode(ids).alias("pos", "id"))
    return rows.groupBy("id").agg(F.min(F.struct(page, "pos")).alias("at")).select("id", F.col(f"at.{page}").alias("page"), "at.pos").orderBy("page", "pos")
