"""Tables of fetched documents (sitemaps, listings, pages) to article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.constants import FEEDS, SITEMAP_ARTICLE_COLUMNS, SITEMAP_ARTICLE_OPTIONAL
from rotativa.functions.dates import written_day
from rotativa.functions.urls import has_base, in_sections
from rotativa.operators.articles import fetched, headline_records, linked_records, listing_links, parse_pages, story_records
from rotativa.operators.dedup import first_url, unseen
from rotativa.operators.filters import date_window, month_from_text, months_overlapping
from rotativa.operators.joins import lookup_pages
from rotativa.operators.rank import rss_top
from rotativa.operators.schema_ops import select_present
from rotativa.session import cut_lineage
from rotativa.sources.xml_feeds import feed_entries, sitemap_children, sitemap_urls


def feed_table(spark, feeds: dict[str, list[str]] = FEEDS) -> DataFrame:
    """The configured feeds in reading order: source, feed_pos, feed_url."""
    rows = [(source, pos, url) for source, urls in feeds.items() for pos, url in enumerate(urls)]
    return spark.createDataFrame(rows, "source string, feed_pos int, feed_url string")


def feed_top(documents: DataFrame, feeds: DataFrame, sources: list[str] | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` entries per source from read feeds.

    ``documents`` holds feed_url, xml and ingested_at; ``feeds`` gives the source and reading order
    of each feed. ``sources`` selects some; unknown names are ignored, but one must be known.
    """
    wanted = feeds.filter(F.col("source").isin(*sources)) if sources else feeds
    if sources and wanted.isEmpty():
        raise ValueError(f"none of these sources is known: {sources}")
    return rss_top(feed_entries(documents.join(wanted, "feed_url")), n)


def sitemaps_to_read(monthly: DataFrame, recent: DataFrame, news_url: str | None, start: str, end: str) -> DataFrame:
    """Sorted distinct sitemap URLs: monthly ones that overlap the window, all recent ones, the news one."""
    month = month_from_text(F.col("loc"))
    urls = months_overlapping(sitemap_children(monthly), month, start, end).select("loc")
    urls = urls.union(sitemap_children(recent).select("loc"))
    if news_url:
        urls = urls.union(urls.sparkSession.createDataFrame([(news_url,)], "loc string"))
    return urls.distinct().orderBy("loc")


def sitemap_candidates(sitemaps: DataFrame, base: str, sections: list[str]) -> DataFrame:
    """Article URLs of the site and sections, first seen in sitemap order: url, lastmod, sitemap_url, pos."""
    entries = sitemap_urls(sitemaps)
    wanted = entries.filter(has_base("url", base) & in_sections("url", sections))
    return first_url(wanted, ["sitemap_url", "pos"])


def sitemap_articles(
    sitemaps: DataFrame, pages: DataFrame, base: str, sections: list[str], start: str, end: str, site: str, with_text: bool
) -> DataFrame:
    """Articles listed in ``sitemaps`` (sitemap_url, xml) and published inside the window.

    URL filters come before the join and the join before the HTML is parsed, so only wanted
    pages reach Python. The list of URLs is checkpointed, as the join reads it more than once.
    """
    wanted = cut_lineage(sitemap_candidates(sitemaps, base, sections).select(F.col("url").alias("link")))
    found = lookup_pages(wanted, fetched(pages)).drop("link")
    records = linked_records(found, site, with_text).withColumn("_day", written_day("fecha_publicacion"))
    inside = date_window(records, "_day", start, end)
    return select_present(inside, SITEMAP_ARTICLE_COLUMNS, SITEMAP_ARTICLE_OPTIONAL)


def story_articles(
    listings: DataFrame, pages: DataFrame, diario: str, host: str, title_css: str | None = None, title_from: str = "text"
) -> DataFrame:
    """Raw article rows for every link of the listing pages (html and other columns); repeated links stay.

    Each listing page is parsed once: its links are checkpointed before the join.
    """
    links = cut_lineage(listing_links(parse_pages(listings), host, title_from=title_from).drop("title"))
    return story_records(lookup_pages(links, fetched(pages)).drop("link"), diario, title_css)


def headline_articles(
    listings: DataFrame, pages: DataFrame, stored: DataFrame, seccion: str, order: list[Column | str] = ("pagina", "pos")
) -> DataFrame:
    """Articles linked from listing pages (pagina, html) whose URL is not stored yet."""
    links = listing_links(parse_pages(listings), article_css="news-article", with_href=True).select("pagina", "pos", F.col("link").alias("url"))
    new = cut_lineage(unseen(links, stored, list(order)).select(F.col("url").alias("link")))
    return headline_records(lookup_pages(new, fetched(pages)).drop("link"), seccion)
