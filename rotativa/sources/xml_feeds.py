"""Feeds and sitemaps held as XML text, one document per row, turned into rows.

A malformed document gives no rows and does not stop the job; ``unreadable`` lists such documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.functions.text import strip_space

_ITEM = "array<struct<title:string,link:string,pubDate:string,updated:string,`dc:date`:string>>"
_RSS = (
    f"channel struct<item:{_ITEM}>,item {_ITEM},"
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string>>"
)
_SITEMAP_INDEX = "sitemap array<struct<loc:string>>"
_URLSET = (
    "url array<struct<loc:string,lastmod:string,"
    "`news:news`:struct<`news:publication_date`:string>>>"
)


def feed_entries(feeds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """RSS items, also those of RSS 1.0, or Atom entries: the other columns, ``entry_pos``, ``title``, ``link``, ``published``.

    ``published`` falls back to ``updated`` and ``dc:date``. Of an Atom entry's links the first one
    that is an alternate, said or implied, counts, else the first.
    """
    doc = F.from_xml(F.col(xml_col), _RSS)
    keep = [c for c in feeds.columns if c != xml_col]
    parsed = feeds.select(*keep, doc.alias("_doc"))
    rss = F.transform(
        F.coalesce("_doc.channel.item", "_doc.item"),
        lambda i: F.struct(
            i["title"].alias("title"), i["link"].alias("link"),
            F.coalesce(i["pubDate"], i["updated"], i["dc:date"]).alias("published"),
        ),
    )

    def atom_link(links: Column) -> Column:
        alternate = F.filter(links, lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(alternate, F.lit(0)), F.get(links, F.lit(0)))["_href"]

    atom = F.transform(
        "_doc.entry",
        lambda e: F.struct(
            e["title"].alias("title"), atom_link(e["link"]).alias("link"),
            F.coalesce(e["published"], e["updated"]).alias("published"),
        ),
    )
    return (
        parsed.select(*keep, F.posexplode(F.coalesce(rss, atom)).alias("entry_pos", "_e"))
        .select(
            *keep,
            "entry_pos",
            strip_space("_e.title").alias("title"),
            F.coalesce(strip_space("_e.link"), F.lit("")).alias("link"),
            F.col("_e.published").alias("published"),
        )
    )


def unreadable(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The quarantine: rows whose document is not well-formed XML or is empty, with an ``error``."""
    bad = F.from_xml(F.col(xml_col), "_corrupt_record string, _text string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    empty = F.trim(F.coalesce(xml_col, F.lit(""))) == ""
    reason = F.when(empty, "empty document").when(bad["_corrupt_record"].isNotNull(), "malformed XML")
    return documents.withColumn("error", reason).filter(F.col("error").isNotNull())


def sitemap_children(indexes: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Child sitemaps of sitemap indexes: the other columns, ``pos`` and ``loc``."""
    keep = [c for c in indexes.columns if c != xml_col]
    doc = F.from_xml(F.col(xml_col), _SITEMAP_INDEX)
    return indexes.select(*keep, F.posexplode(doc["sitemap"]).alias("pos", "_s")).select(
        *keep, "pos", F.coalesce(strip_space("_s.loc"), F.lit("")).alias("loc")
    )


def sitemap_urls(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Entries of sitemaps: the other columns, ``pos``, ``url`` and ``lastmod``.

    A news publication date overrides ``lastmod``; entries without ``loc`` are skipped.
    """
    keep = [c for c in sitemaps.columns if c != xml_col]
    doc = F.from_xml(F.col(xml_col), _URLSET)
    entry = F.col("_u")
    return (
        sitemaps.select(*keep, F.posexplode(doc["url"]).alias("pos", "_u"))
        .select(
            *keep,
            "pos",
            strip_space(entry["loc"]).alias("url"),
            strip_space(
                F.coalesce(entry["news:news"]["news:publication_date"], entry["lastmod"])
            ).alias("lastmod"),
        )
        .filter(F.col("url").isNotNull())
    )
