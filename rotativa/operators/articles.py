"""Listing links and article records from parsed pages, as column expressions.

Input tables have a ``url`` column and an ``html`` column. Three page layouts are covered:

* ``story``: a ``time`` element, a heading, paragraphs inside a body container;
* ``headline``: text in elements with ``news-headline__*`` classes, body in ``article-body``;
* ``linked``: date and section from JSON-LD, text from all long paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.constants import NO_BODY, NO_FEM, NO_MASC, NO_TITLE
from rotativa.functions.dates import day_or_raw, publication_iso, spanish_timestamp
from rotativa.functions.text import clean_text, long_paragraphs, strip_prefix, strip_site_suffix, strip_space
from rotativa.functions.urls import absolute_url, first_segment, nid
from rotativa.sources.html import page_elements


def parse_pages(pages: DataFrame, html_col: str = "html", nest_paragraphs: bool = False) -> DataFrame:
    """Replace the HTML column by ``elements`` and ``error``."""
    keep = [c for c in pages.columns if c != html_col]
    return pages.withColumn("_page", page_elements(html_col, nest_paragraphs)).select(
        *keep, F.col("_page.elements").alias("elements"), F.col("_page.error").alias("error")
    )


def unreadable_pages(pages: DataFrame, html_col: str = "html", nest_paragraphs: bool = False) -> DataFrame:
    """The quarantine: pages that could not be read, or have no HTML, without it and with ``error``."""
    reason = F.when(F.col("elements").isNull(), "no page").otherwise(F.col("error"))
    parsed = parse_pages(pages, html_col, nest_paragraphs).withColumn("error", reason)
    return parsed.filter(F.col("error").isNotNull()).drop("elements")


# Pieces of a page. Each takes the ``elements`` array and yields an element, an array or a text.


def _with(tag: str, css: list[str] | None = None):
    def test(e: Column) -> Column:
        hit = e["tag"] == tag
        return hit if css is None else hit & F.arrays_overlap(e["css"], F.array(*map(F.lit, css)))

    return test


def all_elements(elements: Column, tag: str, css: list[str] | None = None) -> Column:
    return F.filter(elements, _with(tag, css))


def first_element(elements: Column, tag: str, css: list[str] | None = None) -> Column:
    return F.get(all_elements(elements, tag, css), F.lit(0))


def node_text(element: Column, separator: str = "") -> Column:
    """The text nodes of an element joined by ``separator``."""
    return F.array_join(element["texts"], separator)


def meta_content(elements: Column, value: str, attribute: str = "name") -> Column:
    """``content`` of the first ``meta`` whose ``name``, or else ``property``, is ``value``."""
    metas = F.filter(elements, lambda e: (e["tag"] == "meta") & (e[attribute] == value))
    return F.nullif(F.get(metas, F.lit(0))["content"], F.lit(""))


def paragraphs(elements: Column, separator: str = " ") -> Column:
    """Texts of all paragraphs of the page, in order."""
    return F.transform(all_elements(elements, "p"), lambda p: node_text(p, separator))


# Listing pages.


def page_links(parsed: DataFrame, host: Column | str) -> DataFrame:
    """Every anchor with an ``href``: the page columns, ``pos``, ``title``, ``link``."""
    keep = [c for c in parsed.columns if c not in ("elements", "error")]
    anchors = F.filter("elements", lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    return parsed.select(*keep, F.posexplode(anchors).alias("pos", "_a")).select(
        *keep,
        "pos",
        node_text(F.col("_a")).alias("title"),
        absolute_url(F.col("_a.href"), host).alias("link"),
    )


def listing_links(
    parsed: DataFrame,
    host: str | None = None,
    article_css: str | None = None,
    title_from: str = "text",
    label_prefix: str = "Ir a la nota ",
    with_href: bool = False,
) -> DataFrame:
    """First anchor of each ``article``: the page columns, ``pos``, ``title``, ``link``.

    ``with_href`` passes over anchors without a link; otherwise such a first anchor drops its
    article. ``host`` is put before relative links; without it links stay as written. ``title_from``
    is ``text`` or ``label`` (the ``aria-label`` without its prefix).
    """
    keep = [c for c in parsed.columns if c not in ("elements", "error")]
    articles = all_elements(F.col("elements"), "article", [article_css] if article_css else None)
    anchors = F.filter("elements", lambda e: (e["tag"] == "a") & (e["href"].isNotNull() | F.lit(not with_href)))
    first_anchor = F.get(
        F.filter(anchors, lambda a: F.array_contains(a["inside"], F.col("_article.pos"))), F.lit(0)
    )
    title = (
        node_text(F.col("_a")) if title_from == "text" else strip_prefix("_a.label", label_prefix)
    )
    link = F.col("_a.href")
    return (
        parsed.select(*keep, "elements", F.posexplode(articles).alias("pos", "_article"))
        .select(*keep, "pos", first_anchor.alias("_a"))
        .filter(F.col("_a.href").isNotNull())
        .select(
            *keep,
            "pos",
            title.alias("title"),
            (link if host is None else absolute_url(link, host)).alias("link"),
        )
    )


# Article pages.


def fetched(pages: DataFrame, status_col: str = "status") -> DataFrame:
    """Pages that were read successfully."""
    return pages.filter(F.col(status_col) == 200)


def story_records(pages: DataFrame, diario: str, title_css: str | None = None) -> DataFrame:
    """Raw article rows (diario, fecha, titulo noticia, contenido, link) of ``story`` pages."""
    els = F.col("elements")
    created = first_element(els, "time", ["createDate"])["datetime"]
    first_time = first_element(els, "time")
    date = F.coalesce(created, first_time["datetime"], node_text(first_time))
    title = first_element(els, "h1", [title_css] if title_css else None)
    body = F.coalesce(
        first_element(els, "div", ["body", "article-body"])["pos"], first_element(els, "article")["pos"]
    )
    body_paragraphs = F.filter(
        els, lambda e: (e["tag"] == "p") & F.array_contains(e["inside"], F.col("_body"))
    )
    return (
        parse_pages(pages, nest_paragraphs=True)
        .filter(F.col("error").isNull())
        .withColumn("_body", body)
        .select(
            F.lit(diario).alias("diario"),
            day_or_raw(date).alias("fecha"),
            F.coalesce(node_text(title), F.lit(NO_TITLE)).alias("titulo noticia"),
            F.when(F.col("_body").isNull(), NO_BODY)
            .otherwise(F.array_join(F.transform(body_paragraphs, lambda p: node_text(p)), "\n"))
            .alias("contenido"),
            F.col("url").alias("link"),
        )
    )


def headline_records(pages: DataFrame, seccion: str) -> DataFrame:
    """Rows (fecha, fecha_raw, titulo, resumen, articulo, url, seccion) of ``headline`` pages.

    Live blogs are dropped. ``fecha`` is null where ``fecha_raw`` does not parse.
    """
    els = F.col("elements")
    live = F.exists(els, _with("span", ["news-headline-lbp__live-badge"]))
    date = F.coalesce(
        node_text(first_element(els, "span", ["news-headline__publication-date"])), F.lit(NO_FEM)
    )
    title = node_text(first_element(els, "h1", ["news-headline__title"]))
    summary = node_text(first_element(els, "h2", ["news-headline__article-summary"]))
    bodies = all_elements(els, "article", ["article-body"])
    body = F.when(F.size(bodies) > 0, F.array_join(F.transform(bodies, lambda b: node_text(b)), " "))
    return (
        parse_pages(pages, nest_paragraphs=True)
        .filter(F.col("error").isNull() & ~live)
        .select(
            spanish_timestamp(date).alias("fecha"),
            date.alias("fecha_raw"),
            clean_text(F.coalesce(title, F.lit(NO_MASC))).alias("titulo"),
            clean_text(F.coalesce(summary, F.lit(NO_MASC))).alias("resumen"),
            clean_text(F.coalesce(body, F.lit(NO_MASC))).alias("articulo"),
            "url",
            F.lit(seccion).alias("seccion"),
        )
    )


def linked_items(elements: Column) -> Column:
    """JSON-LD objects of type NewsArticle or Article, in page order; bad JSON is skipped."""
    scripts = F.filter(elements, lambda e: (e["tag"] == "script") & e["type"].contains("ld+json"))

    def objects(script: Column) -> Column:
        doc = F.try_parse_json(node_text(script))
        many = F.try_variant_get(doc, "$", "array<variant>")
        return F.coalesce(many, F.array(doc))

    def text(item: Column, field: str) -> Column:
        return F.nullif(F.try_variant_get(item, f"$['{field}']", "string"), F.lit(""))

    items = F.transform(
        F.flatten(F.transform(scripts, objects)),
        lambda i: F.struct(
            text(i, "@type").alias("type"),
            F.coalesce(text(i, "datePublished"), text(i, "dateCreated")).alias("published"),
            text(i, "articleSection").alias("section"),
        ),
    )
    return F.filter(items, lambda i: i["type"].isin("NewsArticle", "Article"))


def _last_known(items: Column, field: str) -> Column:
    known = F.filter(F.transform(items, lambda i: i[field]), lambda v: v.isNotNull())
    return F.try_element_at(known, F.lit(-1))


def linked_records(pages: DataFrame, site: str, with_text: bool = False) -> DataFrame:
    """Rows of ``linked`` pages: id, seccion, fecha_publicacion, titulo, url, bajada, texto, status."""
    els = F.col("elements")
    published = F.coalesce(
        _last_known(F.col("_items"), "published"), meta_content(els, "article:published_time", "property")
    )
    section = F.coalesce(_last_known(F.col("_items"), "section"), first_segment("url"))
    long_ones = long_paragraphs(paragraphs(els))
    text = F.when(F.size(long_ones) > 0, F.array_join(long_ones, "\n\n"))
    return (
        parse_pages(pages)
        .filter(F.col("error").isNull())
        .withColumn("_items", linked_items(els))
        .select(
            nid("url").alias("id"),
            section.alias("seccion"),
            publication_iso(published).alias("fecha_publicacion"),
            strip_site_suffix(node_text(first_element(els, "title")), site).alias("titulo"),
            "url",
            strip_space(meta_content(els, "description")).alias("bajada"),
            (text if with_text else F.lit(None).cast("string")).alias("texto"),
            "status",
        )
    )
