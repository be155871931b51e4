import pytest
from pyspark.sql import functions as F

from rotativa.operators import articles as a
from rotativa.plans.ingestion import feed_table, feed_top, headline_articles, sitemap_articles, sitemaps_to_read, story_articles
from rotativa.plans.consolidation import fold_page_files
from rotativa.schemas import RAW_ARTICLE
from rotativa.sources import readers, sinks
from rotativa.sources import xml_feeds as x

HEADER = "diario,fecha,titulo noticia,contenido,link\n"


@pytest.fixture
def page_files(tmp_path):
    (tmp_path / "pag_1.csv").write_text(
        HEADER
        + 'P,2025-01-02,"Dijo ""no""","uno\ndos, ""tres""\n",l1\n'
        + "P,2024-12-31,borde,x,l2\n"
        + "P,2025-01-03,vacio,,l1\n"
    )
    (tmp_path / "pag_2_abr.csv").write_text(HEADER + "P,2025-05-01,borde,x,l3\nP,2025-04-30,ok,texto,l4\n")
    return f"{tmp_path}/*.csv"


def test_page_files_with_quotes_and_line_breaks(spark, page_files):
    rows = readers.read_page_files(spark, page_files)
    assert rows.count() == 5
    first = rows.filter("link = 'l1' and fecha = '2025-01-02'").first()
    assert first["titulo noticia"] == 'Dijo "no"'
    assert first["contenido"] == 'uno\ndos, "tres"\n'
    per_file = {r["archivo"]: r["n"] for r in rows.groupBy("archivo").agg(F.count("*").alias("n")).collect()}
    assert per_file == {"pag_1.csv": 3, "pag_2_abr.csv": 2}
    assert rows.filter("contenido is null").count() == 1


def test_folded_page_files(spark, page_files):
    folded = fold_page_files(spark, page_files)
    assert sorted(r["link"] for r in folded.collect()) == ["l1", "l1", "l4"]
    assert dict(folded.dtypes)["fecha"] == "date"


def test_sinks_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x\n"y"', ["p", "q"], ""), ("b", None, [], "z")], "k string, t string, l array<string>, e string")
    sinks.write_table(df, f"{tmp_path}/t.PARQUET")
    assert readers.read_table(spark, f"{tmp_path}/t.PARQUET").schema == df.schema
    sinks.write_table(df, f"{tmp_path}/t.csv")
    back = readers.read_table(spark, f"{tmp_path}/t.csv", spark.createDataFrame([], "k string, t string, l string, e string").schema)
    assert {tuple(r) for r in back.collect()} == {("a", 'x\n"y"', '["p","q"]', None), ("b", None, "[]", "z")}
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/t.csv")


def test_empty_tables_keep_their_schema(spark, tmp_path):
    empty = spark.createDataFrame([], RAW_ARTICLE)
    sinks.write_table(empty, f"{tmp_path}/e.parquet")
    assert spark.read.parquet(f"{tmp_path}/e.parquet").columns == RAW_ARTICLE.names
    sinks.write_table(empty, f"{tmp_path}/e.csv")
    assert readers.read_table(spark, f"{tmp_path}/e.csv", RAW_ARTICLE).count() == 0
    header = [p.read_text() for p in tmp_path.glob("e.csv/part-*")]
    assert header and header[0].strip() == "diario,fecha,titulo noticia,contenido,link"


def test_bootstrap_append_and_snapshot(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert readers.table_or_empty(spark, path, RAW_ARTICLE).count() == 0
    row = spark.createDataFrame([("P", "f", "t", "c", "l")], RAW_ARTICLE)
    sinks.append(row, path)
    copy = sinks.snapshot(spark, path, f"{tmp_path}/backups")
    sinks.append(row, path)
    assert readers.table_or_empty(spark, path, RAW_ARTICLE).count() == 2
    assert spark.read.parquet(copy).count() == 1


def test_pages_kept_apart(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 7).alias("pagina"), F.col("id").alias("n"))
    sinks.write_by_page(df, f"{tmp_path}/one", pages_per_dir=1)
    assert len(list(tmp_path.glob("one/page_group=*"))) == 7
    sinks.write_by_page(df, f"{tmp_path}/many", pages_per_dir=4)
    assert len(list(tmp_path.glob("many/page_group=*"))) == 2
    back = spark.read.parquet(f"{tmp_path}/many").select("pagina", "n")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


RSS = (
    "<rss><channel><title>x</title><item><title><![CDATA[ Uno & dos ]]></title>"
    "<pubDate>Fri, 31 Jan 2025 22:30:00 -0300</pubDate></item>"
    "<item><title>Tres</title><link> l3 </link></item></channel></rss>"
)
ATOM = (
    '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://a"/>'
    "<updated>2025-01-01T00:00:00Z</updated></entry></feed>"
)


def test_feed_entries(spark):
    feeds = spark.createDataFrame([("s", 0, RSS), ("s", 1, "<rss><broken"), ("s", 2, ATOM), ("s", 3, None)], "source string, feed_pos int, xml string")
    rows = [tuple(r) for r in x.feed_entries(feeds).orderBy("feed_pos", "entry_pos").collect()]
    assert rows == [
        ("s", 0, 0, "Uno & dos", "", "Fri, 31 Jan 2025 22:30:00 -0300"),
        ("s", 0, 1, "Tres", "l3", None),
        ("s", 2, 0, "A", "http://a", "2025-01-01T00:00:00Z"),
    ]


def index(*locs):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{loc}</loc></sitemap>" for loc in locs) + "</sitemapindex>"


def test_sitemaps_to_read(spark):
    monthly = spark.createDataFrame([(index("s-2024-12.xml", "s-2025-01.xml", "s-2025-04.xml", "s-2025-05.xml", "s-otro.xml"),)], "xml string")
    recent = spark.createDataFrame([(index("r-1.xml", "s-2025-01.xml"),), ("<bad",)], "xml string")
    found = sitemaps_to_read(monthly, recent, "news.xml", "2025-01-31", "2025-04-01")
    assert [r["loc"] for r in found.collect()] == ["news.xml", "r-1.xml", "s-2025-01.xml", "s-2025-04.xml"]


def urlset(*entries):
    urls = "".join(
        "<url>" + (f"<loc>{loc}</loc>" if loc else "") + (f"<lastmod>{mod}</lastmod>" if mod else "")
        + (f"<news:news><news:publication_date>{pub}</news:publication_date></news:news>" if pub else "") + "</url>"
        for loc, mod, pub in entries
    )
    return f'<urlset xmlns:news="http://n">{urls}</urlset>'


def test_sitemap_urls(spark):
    xml = urlset(("a", "2025-01-01", None), ("b", None, "2025-02-02"), ("c", "2025-01-01", "2025-02-02"), (None, "x", None), ("d", None, None))
    found = x.sitemap_urls(spark.createDataFrame([("s", xml)], "sitemap_url string, xml string"))
    assert [tuple(r)[2:] for r in found.orderBy("pos").collect()] == [
        ("a", "2025-01-01"), ("b", "2025-02-02"), ("c", "2025-02-02"), ("d", None)
    ]


LD = (
    '<script type="application/ld+json">[1,{"@type":"Article","dateCreated":"2025-01-31T22:30:00-03:00"},'
    '{"@type":"NewsArticle","datePublished":"","articleSection":"Campo"}]</script>'
    '<script type="application/ld+json">{bad</script>'
    '<script type="application/ld+json">{"@type":"WebPage","datePublished":"2020-01-01"}</script>'
)
LONG = "palabra " * 6
LINKED = (
    f'<html><head><title> Hola &amp; chau - La Nacion </title><meta name="description" content=" desc ">'
    f'<meta property="article:published_time" content="2020-03-01">{LD}<style>p {{}}</style></head>'
    f"<body><p>{LONG}<b> fin</b><p>corto</p><!-- <p>{LONG}</p> --><script>'<p>{LONG}</p>'</script><p>{'x' * 41}</p></body></html>"
)


def linked(spark, html, url="https://www.x.com/economia/campo/a-nid31012025/", with_text=True):
    df = spark.createDataFrame([(url, 200, html)], "url string, status int, html string")
    return a.linked_records(df, "LA NACION", with_text).first()


def test_linked_article(spark):
    row = linked(spark, LINKED)
    assert row["id"] == "31012025"
    assert row["seccion"] == "Campo"
    assert row["fecha_publicacion"] == "2025-01-31T22:30:00-03:00"
    assert row["titulo"] == "Hola & chau"
    assert row["bajada"] == "desc"
    assert row["texto"] == LONG.strip() + " fin\n\n" + "x" * 41
    assert linked(spark, LINKED, with_text=False)["texto"] is None


def test_linked_article_fallbacks(spark):
    meta = '<meta property="article:published_time" content="2025-03-01">'
    row = linked(spark, f"{meta}<title>T</title><p>corto</p>", "https://www.x.com/politica/b/")
    assert (row["seccion"], row["fecha_publicacion"], row["texto"], row["id"]) == ("politica", "2025-03-01T00:00:00", None, None)
    one_object = '<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2025-02-01T01:30:00Z"}</script>'
    assert linked(spark, one_object)["fecha_publicacion"] == "2025-02-01T01:30:00+00:00"
    empty = linked(spark, "", "https://www.x.com")
    assert (empty["seccion"], empty["titulo"], empty["fecha_publicacion"]) == (None, None, None)


@pytest.mark.parametrize(
    "html,fecha,titulo,contenido",
    [
        (
            '<h1>otro</h1><h1 class="storyTitle">T <i> x</i></h1><time datetime="2025-01-02">hoy</time>'
            '<time class="a createDate" datetime="2025-01-03T23:00:00-03:00">z</time>'
            '<div class="body x"><p>a <b> b</b></p><p>c</p></div><p>fuera</p>',
            "2025-01-03", "Tx", "ab\nc",
        ),
        ('<time datetime="2025-01-02T10:00:00Z">hoy</time><article><p>q</p></article>', "2025-01-02", "Título no encontrado", "q"),
        ("<time> ayer </time><div class='article-body'></div>", "ayer", "Título no encontrado", ""),
        ('<time class="createDate">x</time><time datetime="2025-01-02">y</time>', "x", "Título no encontrado", "Contenido no encontrado"),
        ("", "Fecha no encontrada", "Título no encontrado", "Contenido no encontrado"),
    ],
)
def test_story_article(spark, html, fecha, titulo, contenido):
    df = spark.createDataFrame([("u", html)], "url string, html string")
    row = a.story_records(df, "Clarín", "storyTitle").first()
    assert tuple(row) == ("Clarín", fecha, titulo, contenido, "u")


def test_paragraph_left_open(spark):
    df = spark.createDataFrame([("<article><p>a<p>b</p></article>",)], "html string")
    texts = a.paragraphs(F.col("elements"))
    assert a.parse_pages(df).select(texts).first()[0] == ["a", "b"]
    assert a.parse_pages(df, nest_paragraphs=True).select(texts).first()[0] == ["a b", "b"]


def test_headline_articles(spark):
    html = (
        '<h1 class="news-headline__title"> T\n x</h1><span class="news-headline__publication-date">15 de abril 2025 - 14:30</span>'
        '<h2 class="news-headline__article-summary"> s\n s </h2>'
        '<article class="article-body"><p>a\n b</p></article><article class="article-body">c</article>'
    )
    live = '<span class="news-headline-lbp__live-badge">vivo</span>' + html
    df = spark.createDataFrame([("u", html), ("live", live), ("none", "<p>x")], "url string, html string")
    rows = {r["url"]: r for r in a.headline_records(df, "opinion").collect()}
    assert set(rows) == {"u", "none"}
    u = rows["u"]
    assert (str(u["fecha"]), u["titulo"], u["resumen"], u["articulo"]) == ("2025-04-15 14:30:00", "T x", "s s", "a b c")
    n = rows["none"]
    assert (n["fecha"], n["fecha_raw"], n["titulo"], n["articulo"]) == (None, "No encontrada", "No encontrado", "No encontrado")


LISTING = (
    '<article class="news-article"><h2>n</h2><a href="/n1" aria-label="Ir a la nota Uno">uno</a><a href="/z">z</a></article>'
    '<article><p>no</p></article><article><a href="http://q/2"> dos </a></article>'
)


def test_listing_links(spark):
    parsed = a.parse_pages(spark.createDataFrame([(1, LISTING)], "pagina int, html string"))
    assert [tuple(r) for r in a.listing_links(parsed, "https://h").collect()] == [(1, 0, "uno", "https://h/n1"), (1, 2, "dos", "http://q/2")]
    assert [tuple(r) for r in a.listing_links(parsed, None, "news-article", "label").collect()] == [(1, 0, "Uno", "/n1")]


def test_a_bad_page_marks_its_row_only(spark):
    df = spark.createDataFrame([(1, "<![bad x]><p>a</p>"), (2, "<p>b</p>"), (3, None)], "n int, html string")
    rows = {r["n"]: r for r in a.parse_pages(df).collect()}
    assert rows[2]["error"] is None and len(rows[2]["elements"]) == 1
    assert rows[3]["elements"] is None
    assert rows[1]["error"] is not None or len(rows[1]["elements"]) == 1


PAGES = "url string, status int, html string"


def test_sitemap_flow(spark):
    base = "https://s.com"
    maps = spark.createDataFrame(
        [
            ("b.xml", urlset((f"{base}/politica/1/", None, None), (f"{base}/economia/2/", None, None))),
            ("a.xml", urlset((f"{base}/politica/1/", None, None), (f"{base}/deportes/3/", None, None), ("https://o.com/politica/4/", None, None), (f"{base}/politica/5/", None, None), (f"{base}/politica/6/", None, None))),
        ],
        "sitemap_url string, xml string",
    )
    dated = '<meta property="article:published_time" content="{}"><title>{}</title>'
    pages = spark.createDataFrame(
        [
            (f"{base}/politica/1/", 200, dated.format("2025-01-31T22:30:00-03:00", "uno")),
            (f"{base}/economia/2/", 200, dated.format("2025-02-01T01:00:00Z", "dos")),
            (f"{base}/politica/5/", 404, dated.format("2025-01-15", "cinco")),
            (f"{base}/politica/6/", 200, "<title>sin fecha</title>"),
            ("https://o.com/politica/4/", 200, dated.format("2025-01-15", "cuatro")),
        ],
        PAGES,
    )
    found = sitemap_articles(maps, pages, base, ["politica", "economia"], "2025-01-01", "2025-01-31", "X", with_text=False)
    assert found.columns == ["id", "seccion", "fecha_publicacion", "titulo", "url", "bajada", "texto", "status"]
    assert [r["titulo"] for r in found.collect()] == ["uno"]


def test_listing_flows(spark):
    listings = spark.createDataFrame([(1, LISTING), (2, LISTING)], "pagina int, html string")
    pages = spark.createDataFrame(
        [("https://h/n1", 200, "<h1>Uno</h1>"), ("http://q/2", 500, "<h1>Dos</h1>"), ("/n1", 200, "<p>x</p>"), ("/n1", 404, "<p>otra</p>")], PAGES
    )
    stories = story_articles(listings, pages, "Clarín", "https://h")
    assert [(r["titulo noticia"], r["link"]) for r in stories.collect()] == [("Uno", "https://h/n1")] * 2
    nothing = spark.createDataFrame([], "url string")
    assert [r["url"] for r in headline_articles(listings, pages, nothing, "opinion").collect()] == ["/n1"]
    stored = spark.createDataFrame([("/n1",)], "url string")
    assert headline_articles(listings, pages, stored, "opinion").count() == 0


def test_feed_table(spark):
    feeds = feed_table(spark)
    assert feeds.count() == 13
    assert feeds.filter("source = 'Infobae'").count() == 2


def test_top_of_feeds(spark):
    feeds = feed_table(spark, {"s": ["u0", "u1"], "t": ["u2"]})
    item = "<item><title>{}</title><link>{}</link><pubDate>{} Jan 2025 10:00:00 GMT</pubDate></item>"
    documents = spark.createDataFrame(
        [
            ("u0", "<rss><channel>" + item.format("uno", "l1", 1) + item.format("dos", "l2", 2) + "</channel></rss>"),
            ("u1", "<rss><channel>" + item.format("UNO", "l3", 3) + item.format("tres", "l4", 3) + "</channel></rss>"),
            ("u2", "<rss><channel>" + item.format("uno", "l5", 1) + "</channel></rss>"),
            ("u9", "<rss><channel>" + item.format("otro", "l6", 1) + "</channel></rss>"),
        ],
        "feed_url string, xml string",
    ).withColumn("ingested_at", F.lit("2025-02-01").cast("timestamp"))
    assert sorted((r["source"], r["rank_in_source"], r["link"]) for r in feed_top(documents, feeds, n=2).collect()) == [
        ("s", 1, "l4"), ("s", 2, "l2"), ("t", 1, "l5")
    ]
    assert {r["source"] for r in feed_top(documents, feeds, ["t", "zz"]).collect()} == {"t"}
    with pytest.raises(ValueError):
        feed_top(documents, feeds, ["zz"])


def test_few_pages_are_held_at_once():
    import pyarrow as pa

    from rotativa.sources import html

    pages = pa.array(["<p>a</p>", None] * 75)
    parts = list(html._read_batches(iter([pages]), False))
    assert [len(p) for p in parts] == [64, 64, 22] and pa.concat_arrays(parts).null_count == 75
