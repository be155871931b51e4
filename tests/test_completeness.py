"""Cases that ordinary input holds and the test tables don't: nulls, repeats, failures, odd markup."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rotativa.functions.urls import in_sections
from rotativa.operators import articles, features, filters, joins
from rotativa.operators.rank import rss_columns, top_n
from rotativa.plans.extraction import checked_features
from rotativa.plans.ingestion import sitemap_articles
from rotativa.schemas import FEATURES
from rotativa.sources import xml_feeds
from rotativa.streaming import incremental


def test_title_that_left_the_top_stays_known(spark, tmp_path):
    import time

    polls = [[("old", "01"), ("x", "03"), ("y", "05")], [("old", "09"), ("z", "02")], [("old", "10"), ("y", "11")]]
    for i, rows in enumerate(polls):
        frame = spark.createDataFrame([("s", 0, n, t, f"2025-01-{d}T00:00:00Z") for n, (t, d) in enumerate(rows)], "source string, feed_pos int, entry_pos int, title string, published string")
        frame.withColumns({"link": F.lit(""), "ingested_at": F.lit("2025-01-20").cast("timestamp")}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if i < 2 else 0)
    stream = incremental.table_stream(spark, f"{tmp_path}/in", "*.parquet", files_per_batch=1)
    incremental.rolling_top(stream, f"{tmp_path}/top", f"{tmp_path}/offsets", n=2).awaitTermination()
    top = rss_columns(incremental.latest_version(spark, f"{tmp_path}/top"))
    assert [(r["title"], r["rank_in_source"]) for r in top.orderBy("rank_in_source").collect()] == [("y", 1), ("x", 2)]


def test_rows_without_url_are_asked_once_and_failures_come_back(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    folder = str(log)

    def load():
        import uuid

        def ask(prompts):
            if any("malo" in p for p in prompts):
                raise RuntimeError("no")
            for _ in prompts:
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return ["{}"] * len(prompts)

        return ask

    rows = [("D", "f", "S", "t", "uno", None), ("D", "f", "S", "t", "dos", None), ("D", "f", "S", "t", "malo", "u")]
    prompts = features.with_prompt(spark.createDataFrame(rows, "diario string, fecha string, seccion string, titulo string, contenido string, url string"))
    for _ in range(2):
        found = {r["contenido"]: r for r in features.score_missing(prompts, load, f"{tmp_path}/answers").collect()}
        assert found["uno"]["response"] == found["dos"]["response"] == "{}"
        assert found["malo"]["response"] is None and found["malo"]["error"] == "RuntimeError: no"
        assert len(list(log.iterdir())) == 2
    checked = checked_features(features.score_missing(prompts, load, f"{tmp_path}/answers"))
    assert {r["contenido"]: r["violations"] for r in checked.collect()}["malo"] == ["call"]


def test_whole_number_with_a_fraction(spark):
    texts = [('{"evento": {"horizonte_dias": %s}}' % n, want) for n, want in (("21.0", 21), ("21", 21), ('"21.0"', 21), ("21.5", None), ('"unknown"', None))]
    parsed = features.parse_features(spark.createDataFrame(texts, "response string, want int"), schema=FEATURES)
    assert [r["got"] for r in parsed.select(F.col("features.evento.horizonte_dias").alias("got")).collect()] == [w for _, w in texts]


def page(status, url, title="T"):
    head = f'<html><head><title>{title}</title><meta name="x" property="article:published_time" content="2025-01-05T10:00:00Z">'
    return (status, url, f'{head}<meta property="description" content="no"><meta name="description" content="yes"></head><body><p>x</p></body></html>')


def test_a_good_copy_of_a_page_wins(spark):
    urls = [f"https://site/politica/{n}" for n in range(4)]
    entries = "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    sitemaps = spark.createDataFrame([("s", f"<urlset>{entries}</urlset>")], "sitemap_url string, xml string")
    pages = [page(None, urls[0], "bad"), page(200, urls[0]), page(0, urls[1], "bad"), page(200, urls[1]), page(404, urls[2]), page(200, urls[3]), page(200, urls[3])]
    found = sitemap_articles(sitemaps, spark.createDataFrame(pages, "status int, url string, html string"), "https://site", ["politica"], "2025-01-01", "2025-01-31", "SITE", False)
    assert sorted((r["url"], r["titulo"], r["bajada"]) for r in found.collect()) == [(urls[n], "T", "yes") for n in (0, 1, 3)]


def test_json_ld_script_with_a_name(spark):
    html = '<script name="s" type="application/ld+json">{"@type": "Article", "datePublished": "2025-01-02T00:00:00Z"}</script>'
    pages = spark.createDataFrame([("https://s/a/1", 200, html)], "url string, status int, html string")
    assert articles.linked_records(pages, "S").first()["fecha_publicacion"].startswith("2025-01-02")


def test_listing_columns_of_the_same_name_stay(spark):
    listing = spark.createDataFrame([("a", "mine", 1)], "link string, seccion string, url int")
    pages = spark.createDataFrame([("a", "theirs")], "url string, seccion string")
    row = joins.lookup_pages(listing, pages, page_order=[]).first()
    assert (row["listing_seccion"], row["seccion"], row["listing_url"]) == ("mine", "theirs", 1)


def test_first_anchor_with_a_link(spark):
    html = '<article class="news-article"><a name="x"></a><a href="/real">t</a></article>'
    parsed = articles.parse_pages(spark.createDataFrame([(html,)], "html string"))
    assert [r["link"] for r in articles.listing_links(parsed, article_css="news-article", with_href=True).collect()] == ["/real"]
    assert articles.listing_links(parsed, article_css="news-article").count() == 0


def test_feed_forms(spark):
    atom = '<feed><entry><title>a</title><link rel="self" href="no"/><link rel="alternate" href="yes"/><updated>u</updated></entry><entry><title>b</title><link href="plain"/></entry></feed>'
    old = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>c</title></channel><item><title>one</title><link>l</link><dc:date>2025-01-01</dc:date></item></rdf:RDF>'
    rss = "<rss><channel><item><title>r</title><link>k</link><pubDate>p</pubDate></item></channel></rss>"
    feeds = spark.createDataFrame([(1, atom), (2, old), (3, rss), (4, "<rss><bad"), (5, ""), (6, None)], "n int, xml string")
    found = [(r["n"], r["title"], r["link"], r["published"]) for r in xml_feeds.feed_entries(feeds).orderBy("n", "entry_pos").collect()]
    assert found == [(1, "a", "yes", "u"), (1, "b", "plain", None), (2, "one", "l", "2025-01-01"), (3, "r", "k", "p")]
    assert sorted(r["n"] for r in xml_feeds.unreadable(feeds).collect()) == [4, 5, 6]


def test_equal_rows_and_null_keys_are_split(spark):
    rows = spark.createDataFrame([("same", 1)] * 1000 + [(None, 1)] * 1000, "k string, v int").repartition(4)
    hot = joins.hot_keys(rows, ["k"], small=50)
    parts = Counter((r["k"], r["_part"]) for r in joins.split_rows(rows, hot, ["k"]).collect())
    assert len(parts) == 40 and max(parts.values()) <= 80
    one = spark.createDataFrame([("same", 9)], "k string, w int")
    joined = joins.join_one(rows, one, ["k"], "left", small=50)
    assert Counter((r["k"], r["w"]) for r in joined.collect()) == {("same", 9): 1000, (None, None): 1000}


def test_sections_may_be_empty(spark):
    assert spark.range(1).select(in_sections(F.lit("http://a/b/"), []).alias("x")).first()["x"] is False


def test_month_filter_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT DATE'2025-01-31' AS d UNION ALL SELECT DATE'2025-04-01'").write.parquet(f"{tmp_path}/d")
    found = filters.months_overlapping(spark.read.parquet(f"{tmp_path}/d"), F.col("d"), "2025-01-15", "2025-03-31")
    assert found.count() == 1
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(d,2025-01-01)" in plan and "LessThanOrEqual(d,2025-03-31)" in plan


@pytest.mark.parametrize("n", [3, 1500])
def test_large_top_of_equal_rows(spark, n):
    rows = spark.createDataFrame([("a", i) for i in range(4000)], "k string, v int").repartition(5)
    assert sorted(r["v"] for r in top_n(rows, ["k"], [F.col("v").desc()], n).collect()) == list(range(4000 - n, 4000))


def test_unreadable_pages_are_listed(spark):
    pages = spark.createDataFrame([(1, "<p>fine"), (2, None), (3, "<![bad [<p>"), (4, "")], "n int, html string")
    found = {r["n"]: r["error"] for r in articles.unreadable_pages(pages).collect()}
    read = {r["n"] for r in articles.parse_pages(pages).filter("error IS NULL AND elements IS NOT NULL").collect()}
    assert found[2] == "no page" and found.keys() | read == {1, 2, 3, 4} and not found.keys() & read
