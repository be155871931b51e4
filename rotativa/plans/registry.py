"""Every query by name. Each takes the session and the folder of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotativa.constants import BORDER_DAYS, NEWS_COLUMNS, WINDOW_END, WINDOW_START
from rotativa.functions import dates, text, urls
from rotativa.functions.vectors import l2_normalize
from rotativa.operators import (
    aggregates, articles, dedup, feature_days, features, filters, languages, market, near, paging, questions, rank, sampling, schema_ops, similar, terms,
    topics, vectors,
)
from rotativa.operators.joins import backfill, in_table, lookup_pages
from rotativa.plans import consolidation, exploration, extraction, ingestion
from rotativa.plans import driver_tables as data
from rotativa.schemas import RAW_ARTICLE
from rotativa.session import cut_lineage, shared_dir
from rotativa.sources import readers, sinks, xml_feeds
from rotativa.streaming import incremental

STORED_UNTIL = "2025-02-01"
OLD_PAGE = "2025-05-01"


def _iso(c: Column | str) -> Column:
    """Dates and timestamps as text, so that results compare alike everywhere."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _rows(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row per vector element, rounded."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    return parts.withColumns({"i": F.col("i").cast("long"), "x": F.round(F.col("x").cast("double"), 6)})


# Filters and dates


def q_articles_per_day(spark: SparkSession, sf: str) -> DataFrame:
    inside = filters.date_window(data.news(spark, sf))
    return aggregates.counts_by(inside, "fecha", "diario").withColumn("fecha", _iso("fecha"))


def q_date_window(spark, sf):
    return filters.date_window(data.news(spark, sf)).select("doc_id", _iso("fecha").alias("fecha"), "diario", "titulo")


def q_not_in(spark, sf):
    kept = filters.not_in(data.news(spark, sf), "fecha", BORDER_DAYS)
    return kept.select("doc_id", _iso("fecha").alias("fecha"), "diario")


def q_bad_dates(spark, sf):
    raw = data.news(spark, sf).withColumn(
        "fecha", F.when(F.col("seccion") == "de", "Fecha no encontrada").otherwise(_iso("fecha"))
    )
    good, bad = filters.good_and_bad_dates(raw, "fecha")
    count = F.count(F.lit(1)).alias("n")
    marked = [part.groupBy("diario").agg(count).withColumn("parte", F.lit(name)) for name, part in (("good", good), ("bad", bad))]
    return reduce(DataFrame.unionByName, marked)


def _event_days(spark, sf, day):
    iso = F.concat(F.replace(F.substring(_iso("ts"), 1, 19), F.lit(" "), F.lit("T")), F.lit("-03:00"))
    shifted = F.concat(F.replace(F.substring(_iso("ts"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    made = data.table(spark, sf, "events").select("event_id", iso.alias("written_at"), shifted.alias("utc_at"))
    return made.select(
        "event_id", _iso(day("written_at")).alias("dia_offset"), _iso(day("utc_at")).alias("dia_z")
    )


def q_local_day(spark, sf):
    return _event_days(spark, sf, dates.local_day)


def q_written_day(spark, sf):
    return _event_days(spark, sf, dates.written_day)


def q_utc_day(spark, sf):
    return _event_days(spark, sf, dates.utc_day)


def q_publication_iso(spark, sf):
    return _event_days(spark, sf, dates.publication_iso)


def q_feed_dates(spark, sf):
    entries = data.entries_of(data.table(spark, sf, "events"))
    return entries.select(
        "entry_pos", dates.local_iso(dates.feed_utc("published", "ingested_at")).alias("published_at_local"),
        dates.day_or_raw("published").alias("written"),
    )


def q_spanish_dates(spark, sf):
    return data.spanish_orders(spark, sf).select("o_orderkey", _iso(dates.spanish_timestamp("texto_fecha")).alias("fecha"))


def q_month_overlap(spark, sf):
    months = filters.months_overlapping(data.news(spark, sf), F.col("fecha"), "2025-02-10", "2025-03-05")
    by_month = months.groupBy(dates.year_month("fecha").alias("mes")).agg(
        F.count(F.lit(1)).alias("n"), F.min(_iso(dates.month_start("fecha"))).alias("desde"), F.max(_iso(dates.month_end("fecha"))).alias("hasta")
    )
    return by_month


def q_month_windows(spark, sf):
    """Articles whose month overlaps each window; the windows are one per section, from its own days."""
    articles_ = data.news(spark, sf).withColumn("mes", dates.month_start("fecha"))
    windows = articles_.groupBy(F.col("seccion").alias("ventana")).agg(
        F.date_add(F.min("fecha"), 40).alias("start"), F.date_sub(F.max("fecha"), 35).alias("end")
    )
    paired = filters.month_window_join(articles_.groupBy("mes").agg(F.count(F.lit(1)).alias("n")), "mes", windows)
    return paired.select("ventana", _iso("mes").alias("mes"), "n")


# Consolidation and schemas


def _conformed(spark, sf):
    t = data.paper_tables(spark, sf)
    return [
        consolidation.from_headline(t["ambito"]),
        consolidation.from_story(t["clarin"]),
        consolidation.from_linked(t["lanacion"]),
        consolidation.from_story(t["pagina12"]),
    ]


def q_consolidate(spark, sf):
    return consolidation.consolidate(_conformed(spark, sf)).withColumn("fecha", _iso("fecha"))


def q_schema_report(spark, sf):
    names = ["ambito", "clarin", "lanacion", "pagina12"]
    raw = data.paper_tables(spark, sf)
    return schema_ops.schema_drift_rows({n: raw[n] for n in names}, NEWS_COLUMNS)


def q_profile(spark, sf):
    return schema_ops.profile(data.eda_articles(spark, sf).drop("doc_id"))


# Counts and lengths


def q_count_by_source(spark, sf):
    return aggregates.value_counts(data.news(spark, sf), "diario")


def q_count_by_section(spark, sf):
    with_nulls = data.news(spark, sf).withColumn("seccion", F.nullif(F.col("seccion"), F.lit("de")))
    return aggregates.value_counts(with_nulls, "seccion")


def q_count_by_date(spark, sf):
    return aggregates.counts_by(data.news(spark, sf), "fecha").withColumn("fecha", _iso("fecha"))


def _dated(spark, sf):
    return data.eda_articles(spark, sf).withColumn("fecha_dia", dates.utc_day("fecha_publicacion"))


def q_daily_counts(spark, sf):
    counted = aggregates.counts_by(_dated(spark, sf), "fecha_dia", name="count_noticias")
    return counted.withColumn("fecha_dia", _iso("fecha_dia"))


def q_daily_nunique(spark, sf):
    counted = aggregates.distinct_by(_dated(spark, sf), "fecha_dia", "id", "n_ids")
    return counted.withColumn("fecha_dia", _iso("fecha_dia"))


def q_lengths(spark, sf):
    measured = aggregates.with_lengths(data.news(spark, sf), "contenido")
    return measured.select("doc_id", F.col("len_chars").cast("long").alias("len_chars"), F.col("len_words").cast("long").alias("len_words"))


def q_len_hist(spark, sf):
    bars = aggregates.histogram(data.news(spark, sf), text.char_count("contenido"))
    return bars.select(
        F.col("bin").cast("long").alias("bin"), F.round("left_edge", 6).alias("left_edge"), F.round("right_edge", 6).alias("right_edge"), "n"
    )


def q_clean_text(spark, sf):
    return data.news(spark, sf).select("doc_id", text.clean_text("contenido").alias("limpio"))


def q_base_text(spark, sf):
    made = data.eda_articles(spark, sf)
    table_wide = aggregates.with_base_text(made)
    both = aggregates.with_base_text(table_wide, per_row=True, out="texto_fila")
    return both.select("doc_id", "texto_base", "texto_fila")


def q_eda_prepared(spark, sf):
    ready = exploration.prepare(data.eda_articles(spark, sf))
    return ready.select(
        "doc_id", "seccion", _iso("fecha_dia").alias("fecha_dia"),
        F.col("len_chars").cast("long").alias("len_chars"), F.col("len_words").cast("long").alias("len_words"),
    )


# First-seen, ranks, increments


def q_title_dedup(spark, sf):
    kept = dedup.first_title(data.news(spark, sf), "diario", "titulo", ["doc_id"])
    return kept.select("doc_id", "diario", "titulo")


def q_url_dedup(spark, sf):
    return dedup.first_url(data.news(spark, sf), ["pagina", "pos"]).select("doc_id", "url")


def q_rss_topn(spark, sf):
    top = rank.rss_top(data.entries_of(data.table(spark, sf, "events")))
    return top.withColumn("rank_in_source", F.col("rank_in_source").cast("long"))


def q_top_large(spark, sf):
    """Top 5,000 articles per section by length: beyond the group limit Spark applies by itself."""
    measured = data.news(spark, sf).select("doc_id", "seccion", text.char_count("contenido").alias("largo"))
    top = rank.top_n(measured, ["seccion"], [F.col("largo").desc(), F.col("doc_id")], 5000)
    return top.select("doc_id", "seccion", F.col("rank").cast("long").alias("rank"))


def q_source_filter(spark, sf):
    known = [f"src{i}" for i in range(20)]
    wanted = filters.keep_sources(data.news(spark, sf), ["src7", "src3", "nope"], known, "diario")
    return aggregates.value_counts(wanted, "diario")


def q_source_semi(spark, sf):
    """Articles whose paper has at least one labelled article."""
    labelled = data.news(spark, sf).join(data.table(spark, sf, "labels").select("doc_id"), "doc_id").select("diario")
    return in_table(data.news(spark, sf), labelled, "diario").select("doc_id", "diario")


def _stored(spark, sf):
    return data.news(spark, sf).filter(F.col("fecha") < F.lit(STORED_UNTIL).cast("date"))


def _new(spark, sf):
    return dedup.unseen(data.news(spark, sf), _stored(spark, sf), ["pagina", "pos"])


def q_seen_urls(spark, sf):
    return dedup.seen_keys(data.news(spark, sf), "url")


def q_new_urls(spark, sf):
    return _new(spark, sf).select("doc_id", "url")


def q_page_progress(spark, sf):
    known = dedup.seen_keys(_stored(spark, sf)).agg(F.count(F.lit(1)).alias("n")).scalar()
    progress = paging.page_progress(_new(spark, sf), known)
    return progress.select("pagina", "n_nuevas", _iso("primera_fecha").alias("primera_fecha"), "total_urls")


def q_page_cutoff(spark, sf):
    # Listing pages run from new to old.
    dated = data.news(spark, sf).withColumn("fecha", F.date_sub(F.lit("2025-06-30").cast("date"), F.col("pagina").cast("int")))
    return paging.until_old_page(dated, OLD_PAGE).select("doc_id", "pagina")


def q_append_new(spark, sf):
    """Append the unseen articles to the stored table twice; the second time adds nothing."""
    path = shared_dir(spark, "articles")
    columns = ["doc_id", "url", "pagina", "pos"]
    sinks.append(_stored(spark, sf).select(*columns), path)
    for _ in range(2):
        stored = spark.read.parquet(path)
        new = dedup.unseen(data.news(spark, sf).select(*columns), stored, ["pagina", "pos"])
        sinks.append(new.select(*columns), path)
    return spark.read.parquet(path).select("doc_id", "url")


def q_sample_n(spark, sf):
    return sampling.sample_n(data.news(spark, sf), 10, "doc_id", 42).select("doc_id", "diario", "titulo")


def q_first_n(spark, sf):
    return sampling.first_n(data.news(spark, sf), 20, [F.col("fecha").desc(), "doc_id"]).select("doc_id", _iso("fecha").alias("fecha"))


# URLs, feeds, sitemaps, pages


def q_url_section(spark, sf):
    pages = data.table(spark, sf, "pages")
    wanted = pages.filter(urls.has_base("url", "https://") & urls.in_sections("url", ["EN", "es"]))
    return wanted.select("page_id", urls.url_path("url").alias("ruta"), urls.first_segment("url").alias("seccion"))


def q_nid(spark, sf):
    return data.news(spark, sf).select("doc_id", urls.nid("url").alias("id"))


def q_feed_entries(spark, sf):
    found = xml_feeds.feed_entries(data.feed_documents(spark, sf))
    return found.select("source", "feed_pos", F.col("entry_pos").cast("long").alias("entry_pos"), "title", "link", "published")


def q_feed_top(spark, sf):
    documents = data.feed_documents(spark, sf)
    top = ingestion.feed_top(documents.select("feed_url", "ingested_at", "xml"), documents.select("source", "feed_pos", "feed_url"))
    return top.withColumn("rank_in_source", F.col("rank_in_source").cast("long"))


def q_sitemap_urls(spark, sf):
    found = xml_feeds.sitemap_urls(data.sitemaps(spark, sf))
    return found.select("sitemap_url", F.col("pos").cast("long").alias("pos"), "url", "lastmod")


def q_sitemap_index(spark, sf):
    indexes = data.sitemap_indexes(spark, sf)
    recent = data.sitemaps(spark, sf).select(
        F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("sitemap_url"), F.lit("</loc></sitemap></sitemapindex>")).alias("xml")
    )
    return ingestion.sitemaps_to_read(indexes, recent, f"{data.SITE}/sitemap-news.xml", "2025-02-10", "2025-03-05")


def q_links(spark, sf):
    parsed = articles.parse_pages(data.table(spark, sf, "pages"))
    found = articles.page_links(parsed, urls.site_root("url"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "title", "link")


def q_listing_links(spark, sf):
    parsed = articles.parse_pages(data.listing_pages(spark, sf))
    found = articles.listing_links(parsed, data.SITE, "news-article")
    return found.select("pagina", F.col("pos").cast("long").alias("pos"), "title", "link")


def q_article_extract(spark, sf):
    parsed = articles.parse_pages(data.table(spark, sf, "pages"))
    els = F.col("elements")
    return parsed.select(
        "page_id",
        articles.node_text(articles.first_element(els, "title")).alias("titulo"),
        articles.node_text(articles.first_element(els, "h1")).alias("h1"),
        F.size(articles.all_elements(els, "p")).cast("long").alias("n_parrafos"),
        F.size(articles.all_elements(els, "a")).cast("long").alias("n_enlaces"),
    )


def q_paragraphs(spark, sf):
    parsed = articles.parse_pages(data.table(spark, sf, "pages"))
    long_ones = text.long_paragraphs(articles.paragraphs(F.col("elements")))
    return parsed.select("page_id", F.posexplode(long_ones).alias("i", "parrafo")).withColumn("i", F.col("i").cast("long"))


def q_story_articles(spark, sf):
    return articles.story_records(data.article_pages(spark, sf), "Clarín")


def q_headline_articles(spark, sf):
    return articles.headline_records(data.article_pages(spark, sf), "opinion").withColumn("fecha", _iso("fecha"))


def q_sitemap_articles(spark, sf):
    found = ingestion.sitemap_articles(
        data.sitemaps(spark, sf), data.article_pages(spark, sf).drop("page_id"), "https://", ["en", "es"],
        WINDOW_START, WINDOW_END, "LA NACION", with_text=True,
    )
    return found.withColumn("status", F.col("status").cast("long"))


def q_page_lookup(spark, sf):
    listing = xml_feeds.sitemap_urls(data.sitemaps(spark, sf)).select(F.col("url").alias("link"), "lastmod")
    found = lookup_pages(listing, data.article_pages(spark, sf))
    return found.select("link", "lastmod", "page_id")


# The same readers over documents with many entries, failures and odd pieces


def q_feed_many(spark, sf):
    """Entries of feeds in three dialects; those cut off have none."""
    found = xml_feeds.feed_entries(data.many_feeds(spark, sf))
    return found.select("feed", F.col("entry_pos").cast("long").alias("entry_pos"), "title", "link", "published")


def q_feed_quarantine(spark, sf):
    return xml_feeds.unreadable(data.many_feeds(spark, sf)).select("feed", "error")


def q_sitemap_many(spark, sf):
    found = xml_feeds.sitemap_urls(data.many_sitemaps(spark, sf))
    return found.select("sitemap", F.col("pos").cast("long").alias("pos"), "url", "lastmod")


def q_linked_varied(spark, sf):
    """Article records where statuses, JSON-LD and titles vary; failed pages give none, missing ones the address alone."""
    found = articles.linked_records(articles.fetched(data.varied_pages(spark, sf)), "LA NACION", with_text=True)
    return found.withColumn("status", F.col("status").cast("long"))


def q_headline_varied(spark, sf):
    """Records without live blogs."""
    found = articles.headline_records(articles.fetched(data.varied_pages(spark, sf)), "economia")
    return found.select("url", "fecha_raw", "titulo", "resumen", "articulo")


def q_unreadable_pages(spark, sf):
    return articles.unreadable_pages(data.varied_pages(spark, sf)).select("doc_id", "error")


def q_varied_lookup(spark, sf):
    """Every article's URL with the one page that was read for it, the first by id."""
    pages = articles.fetched(data.varied_pages(spark, sf)).withColumnRenamed("doc_id", "page_doc")
    listing = data.news(spark, sf).select("doc_id", F.col("url").alias("link"))
    return lookup_pages(listing, pages, ["page_doc"]).select("doc_id", "page_doc")


def q_listing_labels(spark, sf):
    """Titles from labels, links of the first anchor that has one."""
    parsed = articles.parse_pages(data.labelled_listings(spark, sf))
    found = articles.listing_links(parsed, data.SITE, title_from="label", with_href=True)
    return found.select("pagina", F.col("pos").cast("long").alias("pos"), "title", "link")


def q_page_file_rows(spark, sf):
    """Files per number of rows, of a folder with a CSV file per listing page."""
    path = shared_dir(spark, "page-files")
    rows = data.news(spark, sf).select("pagina", "diario", _iso("fecha").alias("fecha"), F.col("titulo").alias("titulo noticia"), "contenido", F.col("url").alias("link"))
    one = rows.repartition(8, "pagina").sortWithinPartitions("pagina")
    one.write.options(header="true", escape='"').partitionBy("pagina").csv(path)
    read = readers.read_page_files(spark, f"{path}/*/*.csv", RAW_ARTICLE)
    files = aggregates.counts_by(read.withColumn("archivo", F.col("_metadata.file_path")), "archivo", name="filas")
    return aggregates.counts_by(files, "filas", name="archivos")


# Vectors


def _vectors(spark, sf):
    """Vectors of the test table as article vectors: label is the day, the id gives the section."""
    return data.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("fecha_dia"),
        F.when(F.col("vec_id") % 2 == 0, "politica").otherwise("economia").alias("seccion"), "embedding",
    )


def q_l2_normalize(spark, sf):
    doubled = _vectors(spark, sf).withColumn("v", F.transform("embedding", lambda x: x * 2.0))
    return _rows(doubled.withColumn("v", l2_normalize("v")), "v", "vec_id")


def q_daily_vectors(spark, sf):
    return _rows(vectors.mean_vectors(_vectors(spark, sf), ["fecha_dia"]), "embedding", "fecha_dia", "count_noticias")


def q_day_section_vectors(spark, sf):
    means = vectors.mean_vectors(_vectors(spark, sf), ["fecha_dia", "seccion"])
    return _rows(means, "embedding", "fecha_dia", "seccion", "count_noticias")


def q_day_cosine(spark, sf):
    days = cut_lineage(vectors.mean_vectors(_vectors(spark, sf), ["fecha_dia"]))
    similar = vectors.cosine_matrix(days, "fecha_dia")
    return similar.withColumn("cosine", F.round("cosine", 6))


def q_day_pca(spark, sf):
    days = vectors.mean_vectors(_vectors(spark, sf), ["fecha_dia"])
    return exploration.daily_map(days).withColumns({"pc1": F.round("pc1", 6), "pc2": F.round("pc2", 6)})


def q_section_pca(spark, sf):
    points = exploration.section_map(_vectors(spark, sf))
    return points.withColumns({"pc1": F.round("pc1", 6), "pc2": F.round("pc2", 6)})


def q_embed(spark, sf):
    prepared = exploration.prepare(data.eda_articles(spark, sf))
    return exploration.news_embeddings(prepared)


def q_embed_encoder(spark, sf):
    """Unit vectors from an encoder that the caller supplies, here the letters a text has."""
    titles = data.news(spark, sf).select("doc_id", "titulo")
    return _rows(vectors.embed(titles, "titulo", data.load_letter_encoder), "embedding", "doc_id")


def q_exploration_vectors(spark, sf):
    """The day vectors that the exploration flow stores, read back: rows, their length and their counts."""
    prepared = exploration.prepare(data.eda_articles(spark, sf))
    paths = exploration.export(prepared, shared_dir(spark, "exploration"))
    stored = spark.read.parquet(paths["daily_news_embeddings"])
    return stored.select(_iso("fecha_dia").alias("fecha_dia"), "count_noticias", F.size("embedding").cast("long").alias("n"))


def q_exploration_export(spark, sf):
    """The exploration tables written out; returns the daily counts read back from CSV."""
    prepared = exploration.prepare(data.eda_articles(spark, sf))
    paths = exploration.export(prepared, shared_dir(spark, "exploration"))
    schema = T.StructType([T.StructField("fecha_dia", T.StringType()), T.StructField("count_noticias", T.LongType())])
    return readers.read_table(spark, paths["daily_news_counts"], schema)


# Near and similar articles, languages


def q_near_articles(spark, sf):
    """Classes of articles whose texts nearly agree; one of each stays."""
    return near.near_articles(data.news(spark, sf), "doc_id", "contenido")


def q_term_vectors(spark, sf):
    """Articles as unit vectors of hashed tf-idf terms."""
    made = terms.hashed_vectors(data.news(spark, sf), "doc_id", "titulo", 64)
    return _rows(made, "embedding", "doc_id")


def q_similar_articles(spark, sf):
    """The ten nearest other articles of every fiftieth, where their cosine reaches 0.65."""
    made = terms.hashed_vectors(data.news(spark, sf), "doc_id", "contenido")
    found = similar.similar_articles(made, F.col("doc_id") % 50 == 0, "doc_id")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("cosine", 6).alias("cosine"))


def q_similar_days(spark, sf):
    """The five days most like each day."""
    days = cut_lineage(vectors.mean_vectors(_vectors(spark, sf), ["fecha_dia"]))
    found = similar.similar_groups(days, "fecha_dia")
    return found.select("fecha_dia", F.col("rank").cast("long").alias("rank"), "other", F.round("cosine", 6).alias("cosine"))


def _detected(spark, sf):
    """Articles with the language found by profiles of two thirds of them."""
    articles_ = data.news(spark, sf)
    known = languages.profiles(articles_.filter(F.col("doc_id") % 3 != 1), "seccion", "contenido")
    return languages.detect_language(articles_.select("doc_id", "fecha", "seccion", "contenido"), known, "doc_id", "contenido")


def q_language(spark, sf):
    return _detected(spark, sf).select("doc_id", "idioma")


def q_language_days(spark, sf):
    shares = languages.language_shares(_detected(spark, sf), "fecha")
    return shares.select(_iso("fecha").alias("fecha"), "idioma", "n", F.round("share", 9).alias("share"))


def _topics(spark, sf):
    return topics.factorise(topics.term_cells(data.news(spark, sf), "fecha", "titulo"), 3, rounds=4)


def q_topics(spark, sf):
    """The ten strongest terms of three topics of the titles of days."""
    found = topics.topic_terms(_topics(spark, sf))
    return found.select(F.col("topic").cast("long").alias("topic"), F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 7).alias("weight"))


def q_topic_days(spark, sf):
    """What share of each day's titles is each topic's, and the squared error of the whole."""
    made = _topics(spark, sf)
    shares = topics.topic_shares(made).withColumn("error", F.lit(made.errors[-1]))
    return shares.select(F.col("row").alias("fecha"), F.col("topic").cast("long").alias("topic"), F.round("share", 7).alias("share"), F.round("error", 3).alias("error"))


# Next-day targets, correlations, question bank


def _daily_target(spark, sf):
    return market.next_traded(data.daily_news(spark, sf), data.market(spark, sf))


def q_next_traded(spark, sf):
    """Days of news with the close known on the day and that of the next traded day."""
    found = _daily_target(spark, sf)
    return found.select(_iso("fecha").alias("fecha"), "n_noticias", "cierre_previo", "cierre_siguiente", F.round("retorno", 9).alias("retorno"))


def q_next_day_ridge(spark, sf):
    """The next close from the number and length of a day's articles."""
    found = market.ridge(_daily_target(spark, sf), ["n_noticias", "largo"], "cierre_siguiente", 1.0)
    return found.withColumn("coefficient", F.round("coefficient", 6))


def q_next_day_folds(spark, sf):
    """Errors of that regression on later days than those it learnt from."""
    folds = market.time_folds(_daily_target(spark, sf), 3)
    found = market.fold_errors(folds, ["n_noticias", "largo"], "cierre_siguiente", 1.0)
    return found.select(F.col("fold").cast("long").alias("fold"), "n_aprende", "n_prueba", F.round("error", 6).alias("error"), F.round("error_base", 6).alias("error_base"))


def q_axis_correlations(spark, sf):
    """Daily counts and shares of a section against the days' principal components, up to two days later."""
    made = _vectors(spark, sf)
    axes = exploration.daily_map(vectors.mean_vectors(made, ["fecha_dia"]))
    share = made.groupBy("fecha_dia").agg(F.avg((F.col("seccion") == "politica").cast("double")).alias("politica"))
    days = axes.withColumns({"pc1": F.round("pc1", 6), "pc2": F.round("pc2", 6)}).join(share, "fecha_dia")
    dated = days.withColumn("fecha", F.date_add(F.lit(data.FIRST_DAY).cast("date"), F.col("fecha_dia").cast("int")))
    found = market.lagged_correlations(dated, ["count_noticias", "politica"], ["pc1", "pc2"], "fecha", [0, 1, 2])
    return found.select("a", "b", F.col("lag").cast("long").alias("lag"), "n", F.round("corr", 6).alias("corr"))


def q_question_prompts(spark, sf):
    """The bank's questions as they are put to each article."""
    fields = {c: c for c in ("diario", "fecha", "seccion", "titulo")}
    asked = questions.with_questions(data.news(spark, sf), data.BANK, fields)
    return asked.select("doc_id", F.explode("questions").alias("q")).select("doc_id", "q.id", "q.prompt")


def q_question_answers(spark, sf):
    """Every answer, read by its question's kind, or what is wrong with it."""
    found = questions.checked_answers(data.question_answers(spark, sf), data.BANK, ["doc_id"])
    return found.drop("raw")


def q_question_days(spark, sf):
    """Answers per day and question: how many, how many valid, the mean of the numbers, and how many positive or bullish."""
    found = questions.checked_answers(data.question_answers(spark, sf), data.BANK, ["fecha"])
    days = questions.answer_summary(found, ["fecha"])
    up = F.coalesce(F.try_element_at("labels", F.lit("alcista")), F.try_element_at("labels", F.lit("positivo")), F.lit(0))
    return days.select(_iso("fecha").alias("fecha"), "question", "n", "valid", F.round("avg_value", 9).alias("avg_value"), up.cast("long").alias("up"))


# Model features


def q_prompt(spark, sf):
    return features.with_prompt(data.news(spark, sf)).select("doc_id", "user_prompt")


def q_score(spark, sf):
    asked = features.score(features.with_prompt(data.news(spark, sf)), data.load_stub_scorer)
    parsed = features.parse_features(asked)
    return parsed.select(
        "doc_id", F.col("features.evento.horizonte_dias").cast("long").alias("largo"),
        F.col("features.tematicas.menciona_inflacion").alias("inflacion"), F.col("features.tematicas.menciona_pbi").alias("pbi"),
    )


def q_score_missing(spark, sf):
    """Score with a stored answer table; the second pass, whose model only fails, finds every answer there."""
    path = shared_dir(spark, "answers")
    prompts = features.with_prompt(data.news(spark, sf)).select("doc_id", "url", "user_prompt")
    features.score_missing(prompts, data.load_stub_scorer, path)
    answered = features.parse_features(features.score_missing(prompts, data.load_no_scorer, path))
    return answered.select(
        "doc_id", "url", F.col("features.evento.horizonte_dias").cast("long").alias("largo"),
        F.col("features.tematicas.menciona_reservas").alias("reservas"), F.col("error").isNull().alias("answered"),
    )


def q_parse_features(spark, sf):
    parsed = features.parse_features(data.answers(spark, sf))
    f = F.col("features")
    return parsed.select(
        "doc_id", "corrupt", f["confianza"].alias("confianza"), f["evento"]["tipo_evento"].alias("tipo_evento"),
        f["evento"]["horizonte_dias"].cast("long").alias("horizonte_dias"), f["tematicas"]["menciona_fmi"].alias("menciona_fmi"),
        f["mercado"]["merval"]["direccion"].alias("direccion"),
    )


def q_validate_features(spark, sf):
    checked = features.validate_features(features.parse_features(data.answers(spark, sf)))
    return checked.select(
        "doc_id", F.col("features.evento.tipo_evento").alias("tipo_evento"),
        F.col("features.entidades.tipo_actor_principal").alias("actor"),
        F.col("features.entidades.nombre_actor_principal").alias("nombre"),
        F.size("features.entidades.tickers_mencionados").cast("long").alias("n_tickers"),
        F.array_join(F.array_sort("violations"), ",").alias("violations"),
    )


def q_llm_backfill(spark, sf):
    filled = extraction.checked_features(data.answers(spark, sf))
    return filled.select("doc_id", *[F.col(f"features.{c}").alias(c) for c in features.METADATA])


def q_backfill_join(spark, sf):
    """Answers kept apart from their articles get their metadata by key."""
    apart = features.parse_features(data.answers(spark, sf)).select("doc_id", "features.diario", "features.fecha", "features.seccion")
    source = data.news(spark, sf).withColumn("fecha", _iso("fecha"))
    return backfill(apart, source, "doc_id", ["diario", "fecha", "seccion"])


def q_flatten(spark, sf):
    flat = features.flatten(extraction.checked_features(data.answers(spark, sf)))
    lists = {c: F.array_join(c, "|") for c, t in flat.dtypes if t.startswith("array")}
    return flat.withColumns(lists).withColumn("evento__horizonte_dias", F.col("evento__horizonte_dias").cast("long"))


def q_feature_flow(spark, sf):
    found = extraction.extract_features(data.news(spark, sf), data.load_stub_scorer)
    return found.select(
        "doc_id", *[F.col(f"features.{c}").alias(c) for c in features.METADATA],
        F.col("features.tematicas.menciona_deuda").alias("deuda"), F.size("violations").cast("long").alias("n_violations"),
    )


def q_daily_features(spark, sf):
    """Averages, weighted averages, shares and enum counts per day and paper."""
    flat = features.flatten(extraction.checked_features(data.answers(spark, sf)))
    days = feature_days.feature_summary(flat, ["fecha", "diario"], "calidad_fuente__calidad_fuente_score")
    return days.select(
        "fecha", "diario", "n_articles",
        *[F.round(c, 9).alias(c) for c in (
            "avg_mercado__merval__direccion", "wavg_mercado__merval__direccion", "avg_evento__horizonte_dias",
            "wavg_evento__horizonte_dias", "share_tematicas__menciona_fmi",
        )],
        "n_evento__tipo_evento__fiscal", "n_evento__tipo_evento__desconocido", "n_evento__shock__mixto",
    )


def q_sections(spark, sf):
    """Articles per normalised section; the raw names differ in case, accents and blanks."""
    spelt = F.create_map(*[F.lit(x) for x in ("en", "Política", "de", " POLITICA", "fr", "Economía", "es", "eco  nomica")])
    raw = data.news(spark, sf).withColumn("seccion", F.element_at(spelt, F.col("seccion")))
    normal = feature_days.normal_section("seccion", {"eco nomica": "economia"})
    return aggregates.counts_by(raw.withColumn("seccion", normal), "seccion")


def q_top_per_day(spark, sf):
    """The two longest articles of each paper and day."""
    measured = data.news(spark, sf).select("doc_id", "diario", _iso("fecha").alias("fecha"), text.char_count("contenido").alias("largo"))
    top = rank.top_n(measured, ["diario", "fecha"], [F.col("largo").desc(), F.col("doc_id")], 2)
    return top.select("doc_id", "diario", "fecha", F.col("rank").cast("long").alias("rank"))


def q_top_rows(spark, sf):
    """The 1,500 largest order lines per flag: groups above Spark's own limit, and really cut."""
    lines = data.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    order = [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    top = rank.top_n(lines, ["l_returnflag"], order, 1500)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


def q_score_failures(spark, sf):
    """Stored answers where some calls fail and some articles have no URL: asked twice, errors come back."""
    path = shared_dir(spark, "answers")
    url = F.when(F.col("doc_id") % 5 > 0, F.col("url"))
    prompts = features.with_prompt(data.news(spark, sf).withColumn("url", url)).select("doc_id", "seccion", "user_prompt", url.alias("url"))
    for _ in range(2):
        answered = features.score_missing(prompts, data.load_failing_scorer, path)
    return answered.select("doc_id", F.col("response").isNotNull().alias("answered"), "error")


def q_list_text(spark, sf):
    """Lists stored as text with single quotes, read back as arrays."""
    shown = F.concat(F.lit("['"), F.col("diario"), F.lit("', \"l'"), F.col("seccion"), F.lit("\", 'a\\xa0b']"))
    return data.news(spark, sf).select("doc_id", F.array_join(features.read_list_text(shown), "|").alias("lista"))


# Sinks and streams


def q_csv_roundtrip(spark, sf):
    """Articles written as CSV and read back, quotes and line breaks included."""
    path = shared_dir(spark, "csv") + "/articles.csv"
    rows = data.news(spark, sf).select(
        "diario", _iso("fecha").alias("fecha"), F.col("titulo").alias("titulo noticia"), "contenido", F.col("url").alias("link")
    )
    sinks.write_table(rows, path)
    return readers.read_table(spark, path, RAW_ARTICLE).withColumnRenamed("titulo noticia", "titulo")


def q_snapshot(spark, sf):
    """A stored table copied to a dated folder before it is replaced; the copy is what comes back."""
    path, backups = shared_dir(spark, "news"), shared_dir(spark, "backups")
    rows = data.news(spark, sf).select("doc_id", "diario", "pagina")
    rows.write.parquet(path)
    kept = sinks.snapshot(spark, path, backups)
    rows.limit(0).write.mode("overwrite").parquet(path)
    return spark.read.parquet(kept)


def q_empty_tables(spark, sf):
    """Tables written without rows keep their columns, so they still go together with others."""
    rows = data.news(spark, sf).select("doc_id", "diario", F.lit(None).cast("string").alias("nota"))
    out = rows
    for suffix in ("csv", "parquet"):
        path = f"{shared_dir(spark, 'empty')}/none.{suffix}"
        sinks.write_table(rows.limit(0), path)
        out = out.unionByName(readers.read_table(spark, path, rows.schema))
    return out


def q_page_files(spark, sf):
    """Listing pages kept apart on disk, read back as counts per page."""
    path = shared_dir(spark, "pages")
    sinks.write_by_page(data.news(spark, sf).select("doc_id", "pagina", "diario"), path)
    return aggregates.counts_by(spark.read.parquet(path), "pagina")


def _event_stream(spark, sf):
    """The events in the order of their ids, four files that arrive one after the other."""
    events, path = data.table(spark, sf, "events"), shared_dir(spark, "arriving")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for part in range(4):
        # Each commit is newer than the one before, which is the order a stream reads files in.
        inside = F.col("event_id").between(part * last // 4 + (1 if part else 0), (part + 1) * last // 4)
        events.filter(inside).coalesce(1).write.mode("append").parquet(path)
    return incremental.table_stream(spark, path, "*.parquet", files_per_batch=1)


def q_stream_dedup(spark, sf):
    """First event of each (user, type), kept by a stream in a table keyed by both."""
    path, checkpoint = shared_dir(spark, "stream-table"), shared_dir(spark, "stream-offsets")
    keyed = _event_stream(spark, sf).select(
        F.concat_ws("/", "user_id", "event_type").alias("url"), "event_id", F.col("ts").cast("string").alias("ts")
    )
    for _ in range(2):  # started again, it goes on from its offsets and state, and finds nothing new
        incremental.append_unseen(keyed, path, checkpoint, ["event_id"]).awaitTermination()
    return spark.read.parquet(path)


def q_stream_window_dedup(spark, sf):
    """Keys that pass the watermarked de-duplication of a stream."""
    path, checkpoint = shared_dir(spark, "stream-table"), shared_dir(spark, "stream-offsets")
    stream = _event_stream(spark, sf).select(F.concat_ws("/", "user_id", "event_type").alias("url"), "ts")
    kept = incremental.drop_repeats(stream, ["url"], "ts", "40 days").select("url")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


def q_stream_daily(spark, sf):
    path, checkpoint = shared_dir(spark, "stream-table"), shared_dir(spark, "stream-offsets")
    incremental.daily_counts(_event_stream(spark, sf), path, checkpoint, "ts").awaitTermination()
    return incremental.latest_version(spark, path).withColumn("fecha_dia", _iso("fecha_dia"))


def q_stream_top(spark, sf):
    path, checkpoint = shared_dir(spark, "stream-table"), shared_dir(spark, "stream-offsets")
    entries = data.entries_of(_event_stream(spark, sf))
    incremental.rolling_top(entries, path, checkpoint).awaitTermination()
    top = rank.rss_columns(incremental.latest_version(spark, path))
    return top.withColumn("rank_in_source", F.col("rank_in_source").cast("long"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("q_")}
