"""The test tables seen as news data: articles, feed entries, sitemaps, pages and answers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.constants import MONTHS_ES
from rotativa.operators.questions import Question

FIRST_DAY = "2024-12-30"
SITE = "https://www.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(key: str) -> Column:
    """One of the 124 days that start at FIRST_DAY."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col(key) % 124).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles. Copies of a text share a URL; ``pagina`` holds 11 articles."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(
        F.lit(f"{SITE}/"), F.col("lang"), F.lit("/nota-"), F.md5("text"), F.lit("-nid"), F.col("n_chars").cast("string"), F.lit("/")
    )
    return docs.select(
        "doc_id",
        F.col("source").alias("diario"),
        F.col("lang").alias("seccion"),
        _day("doc_id").alias("fecha"),
        F.trim(F.split_part("text", F.lit("."), F.lit(1))).alias("titulo"),
        F.col("text").alias("contenido"),
        url.alias("url"),
        F.floor(F.col("doc_id") / 11).alias("pagina"),
        F.col("doc_id").alias("pos"),
    )


def paper_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Articles as the four tables the papers' readers leave: three languages, and all the rest."""
    articles = news(spark, sf_dir)
    text_day = F.col("fecha").cast("string")
    story = [
        F.lit("Pagina 12").alias("diario"),
        text_day.alias("fecha"),
        F.col("titulo").alias("titulo noticia"),
        "contenido",
        F.col("url").alias("link"),
    ]
    return {
        "ambito": articles.filter("seccion = 'de'").select(
            F.concat(text_day, F.lit(" 10:30:00")).alias("fecha"), "titulo", F.lit("").alias("resumen"),
            F.col("contenido").alias("articulo"), "url", F.lit("opinion").alias("seccion"),
        ),
        "clarin": articles.filter("seccion = 'en'").select(F.lit("Clarín").alias("diario"), *story[1:]),
        "lanacion": articles.filter("seccion = 'es'").select(
            F.col("doc_id").cast("string").alias("id"), "seccion",
            F.concat(text_day, F.lit("T22:30:00-03:00")).alias("fecha_publicacion"), "titulo", "url",
            F.lit(None).cast("string").alias("bajada"), F.col("contenido").alias("texto"), F.lit(200).alias("status"),
        ),
        "pagina12": articles.filter("seccion IS NULL OR seccion NOT IN ('de', 'en', 'es')").select(*story),
    }


def eda_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with ISO dates near midnight, as the exploration flow reads them."""
    return news(spark, sf_dir).select(
        "doc_id",
        F.regexp_extract("url", r"-nid(\d+)", 1).alias("id"),
        "seccion",
        F.concat(F.col("fecha").cast("string"), F.lit("T22:30:00-03:00")).alias("fecha_publicacion"),
        "titulo",
        "url",
        F.lit("bajada").alias("bajada"),
        F.when(F.col("seccion") != "de", F.col("contenido")).alias("texto"),
    )


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MESES = list(MONTHS_ES)


def _name_of_month(ts: str, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.month(ts))


def entries_of(events: DataFrame) -> DataFrame:
    """Events as feed entries. The date layout depends on the event type and is absent for errors."""
    clock = F.substring(F.col("ts").cast("string"), 12, 8)
    rfc = F.concat_ws(" ", F.dayofmonth("ts").cast("string"), _name_of_month("ts", _MONTHS), F.year("ts").cast("string"), clock)
    iso = F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T"), clock)
    published = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "view", F.concat(rfc, F.lit(" GMT")))
        .when(F.col("event_type") == "click", F.concat(rfc, F.lit(" -0300")))
        .otherwise(F.concat(iso, F.lit("Z")))
    )
    return events.select(
        F.col("event_type").alias("source"),
        F.lit(0).alias("feed_pos"),
        F.col("event_id").alias("entry_pos"),
        F.col("props").alias("title"),
        F.concat(F.lit("https://example.com/e/"), F.col("event_id").cast("string")).alias("link"),
        published.alias("published"),
        F.lit("2024-02-01T00:00:00Z").cast("timestamp").alias("ingested_at"),
    )


def spanish_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date spelt in Spanish; the clock comes from the order key."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(
        F.dayofmonth("o_orderdate").cast("string"), F.lit(" de "), _name_of_month("o_orderdate", _MESES), F.lit(" "),
        F.year("o_orderdate").cast("string"), F.lit(" - "),
        _two(F.col("o_orderkey") % 24), F.lit(":"), _two(F.col("o_orderkey") % 60),
    )
    return orders.select("o_orderkey", text.alias("texto_fecha"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a daily close: their mean price on working days."""
    priced = table(spark, sf_dir, "orders").groupBy(_day("o_orderkey").alias("fecha")).agg(F.round(F.avg("o_totalprice"), 4).alias("cierre"))
    return priced.filter(~F.dayofweek("fecha").isin(1, 7))


def daily_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and their mean length per day."""
    return news(spark, sf_dir).groupBy("fecha").agg(F.count(F.lit(1)).alias("n_noticias"), F.avg(F.length("contenido")).alias("largo"))


# Questions that the stand-in answers below belong to.
BANK = (
    Question("tendencia", "choice", "{diario} {fecha}: {titulo}", ("alcista", "bajista")),
    Question("sube", "number", "{fecha}: {titulo}"),
    Question("mineria", "impact", "{titulo}", high=3.0),
    Question("exterior", "flag", "{seccion}"),
)


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a made answer to every question of the bank, some of them wrong, missing or unreadable."""
    n = F.col("doc_id")
    trend = F.when(n % 4 == 0, " Alcista").when(n % 4 == 1, "bajista").when(n % 4 == 2, "lateral")
    impact = F.concat(F.when(n % 2 == 0, "+").otherwise("-"), (n % 6).cast("string"))
    abroad = F.when(n % 3 == 0, "SI").when(n % 3 == 1, "no").otherwise("tal vez")
    answer = F.to_json(F.struct(trend.alias("tendencia"), (F.length("contenido") % 130).alias("sube"), impact.alias("mineria"), abroad.alias("exterior")))
    response = F.when(n % 17 == 0, "sin respuesta").otherwise(answer)
    return news(spark, sf_dir).select("doc_id", "diario", "fecha", "seccion", "titulo", response.alias("response"))


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed document per event, with one item."""
    entries = entries_of(table(spark, sf_dir, "events"))
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.col("published"), F.lit("</pubDate>")), F.lit(""))
    xml = F.concat(
        F.lit("<rss><channel><title>x</title><item><title><![CDATA[ "), F.col("title"), F.lit(" ]]></title><link>"),
        F.col("link"), F.lit("</link>"), date, F.lit("</item></channel></rss>"),
    )
    url = F.concat(F.lit(f"{SITE}/feed/"), F.col("entry_pos").cast("string"))
    return entries.select("source", F.col("entry_pos").alias("feed_pos"), url.alias("feed_url"), "ingested_at", xml.alias("xml"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap document per page; pages with an odd id carry a news publication date."""
    pages = table(spark, sf_dir, "pages")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    day = _day("page_id").cast("string")
    dated = F.when(
        F.col("page_id") % 2 == 1,
        F.concat(F.lit("<news:news><news:publication_date>"), day, F.lit("</news:publication_date></news:news>")),
    ).otherwise("")
    xml = F.concat(
        F.lit('<urlset xmlns:news="http://example.com/news"><url><loc>'), url,
        F.lit("</loc><lastmod>2024-06-01</lastmod>"), dated, F.lit("</url></urlset>"),
    )
    return pages.select(F.concat(F.lit(f"{SITE}/sitemap-"), F.col("page_id").cast("string")).alias("sitemap_url"), xml.alias("xml"))


def sitemap_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap index per article, naming the sitemap of its month."""
    month = F.date_format("fecha", "yyyy-MM")
    xml = F.concat(
        F.lit("<sitemapindex><sitemap><loc>"), F.lit(f"{SITE}/sitemap-"), month, F.lit(".xml</loc></sitemap></sitemapindex>")
    )
    return news(spark, sf_dir).select(xml.alias("xml"))


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the date, summary and class names that article pages carry."""
    pages = table(spark, sf_dir, "pages")
    day = _day("page_id")
    head = F.concat(
        F.lit('<meta name="description" content=" page '), F.col("page_id").cast("string"), F.lit(' ">'),
        F.lit('<meta property="article:published_time" content="'), day.cast("string"), F.lit('T22:30:00-03:00">'),
        F.lit('<time class="createDate" datetime="'), day.cast("string"), F.lit('T22:30:00-03:00">x</time>'),
        F.lit('<span class="news-headline__publication-date">'), F.dayofmonth(day).cast("string"), F.lit(" de "),
        F.element_at(F.array(*map(F.lit, _MESES)), F.month(day)), F.lit(" "), F.year(day).cast("string"),
        F.lit(" - 14:30</span>"),
    )
    body = F.replace("html", F.lit("<article>"), F.lit('<article class="article-body">'))
    body = F.replace(body, F.lit("<h1>"), F.lit('<h1 class="news-headline__title">'))
    return pages.select("page_id", "url", F.lit(200).alias("status"), F.concat(head, body).alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose menu entries are made article teasers."""
    pages = table(spark, sf_dir, "pages")
    html = F.replace("html", F.lit("<li>"), F.lit('<article class="news-article">'))
    html = F.replace(html, F.lit("</li>"), F.lit("</article>"))
    return pages.select(F.col("page_id").alias("pagina"), html.alias("html"))


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per article, with all that readers must put up with.

    Copies of a text share a URL. By the id: failed and unknown statuses, missing pages, live badges, site
    names behind titles, and JSON-LD as an object, as a list, with a broken script before it, with items that
    are no articles, or left out for a meta element.
    """
    n, day = F.col("doc_id"), F.col("fecha").cast("string")
    ident = n.cast("string")
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    whole = script(F.concat(F.lit('{"@type": "NewsArticle", "datePublished": "'), day, F.lit('T10:00:00-03:00", "articleSection": "Politica"}')))
    several = script(
        F.concat(F.lit('[{"@type": "Organization", "articleSection": "x"}, {"@type": "Article", "dateCreated": "'), day, F.lit('T11:30:00Z", "articleSection": ""}]'))
    )
    strange = script(F.concat(F.lit('[1, "x", null, {"@type": ["NewsArticle"], "datePublished": "1999-01-01"}, {"@type": "WebPage"}]')))
    broken = F.concat(script(F.lit('{"@type": "NewsArticle", "datePublished": ')), whole)
    meta = F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T09:15:00.250-0300">'))
    described = F.when(n % 5 == 0, whole).when(n % 5 == 1, several).when(n % 5 == 2, broken).when(n % 5 == 3, F.concat(strange, meta)).otherwise(meta)
    site = F.when(n % 3 == 0, " - LA NACION").when(n % 3 == 1, "-la nacion  ").otherwise(" - LA NACION Deportes")
    badge = F.when(n % 4 == 0, '<span class="news-headline-lbp__live-badge">VIVO</span>').otherwise("")
    summary = F.when(n % 2 == 0, F.concat(F.lit('<h2 class="news-headline__article-summary"> Resumen \n '), ident, F.lit(" </h2>"))).otherwise("")
    html = F.concat(
        F.lit("<html><head><title> Nota "), ident, site, F.lit('</title><meta name="description" content=" bajada '), ident, F.lit('  ">'),
        described, F.lit("</head><body>"), badge, F.lit('<h1 class="news-headline__title big">Titular  '), ident, F.lit("</h1>"), summary,
        F.lit('<article class="article-body"><p>corto '), ident, F.lit("</p><p>Un parrafo que pasa de los cuarenta caracteres, numero "),
        ident, F.lit("</p></article></body></html>"),
    )
    status = F.when(n % 7 == 0, 404).when(n % 7 == 1, F.lit(None)).otherwise(200)
    pages = news(spark, sf_dir).select("doc_id", "url", status.cast("int").alias("status"), F.when(n % 11 > 0, html).alias("html"))
    return pages


def labelled_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of eleven articles: some anchors have a label, some no link, some come second."""
    n = F.col("doc_id")
    ident = n.cast("string")
    label = F.when(n % 3 == 0, F.concat(F.lit(' aria-label="Ir a la nota Titular '), ident, F.lit('"'))).when(
        n % 3 == 1, F.concat(F.lit(' aria-label="Titular '), ident, F.lit('"'))
    ).otherwise("")
    link = F.when(n % 5 > 0, F.concat(F.lit(' href="'), F.when(n % 2 == 0, F.lit(SITE)).otherwise(""), F.lit("/nota/"), ident, F.lit('"'))).otherwise("")
    item = F.concat(F.lit("<article><div><a"), label, link, F.lit(">texto "), ident, F.lit('</a></div><a href="/otra">otra</a></article>'))
    rows = news(spark, sf_dir).select("pagina", F.struct("doc_id", item.alias("item")).alias("i"))
    joined = rows.groupBy("pagina").agg(F.array_sort(F.collect_list("i")).alias("items"))
    return joined.select("pagina", F.concat(F.lit("<html><body><a href='/menu'>menu</a>"), F.array_join("items.item", "\n"), F.lit("</body></html>")).alias("html"))


def many_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of up to twenty entries, by turns RSS 2.0, Atom, RSS 1.0 and cut off in the middle."""
    n = F.col("event_id")
    kind = F.floor(n / 20) % 4
    ident, link = n.cast("string"), F.concat(F.lit("https://example.com/e/"), n.cast("string"))
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    rss = F.concat(
        F.lit("<item><title><![CDATA[ T & "), ident, F.lit("]]></title>"), F.when(n % 6 > 0, F.concat(F.lit("<link> "), link, F.lit("</link>"))).otherwise(""),
        F.when(n % 4 > 0, F.concat(F.lit("<pubDate>"), day, F.lit("</pubDate>"))).otherwise(F.concat(F.lit("<updated>u "), day, F.lit("</updated>"))), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry><title>A "), ident, F.lit('</title><link rel="self" href="self"/>'),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("<link"), F.when(n % 3 == 1, F.lit(' rel="alternate"')).otherwise(""), F.lit(' href="'), link, F.lit('"/>'))),
        F.lit("<updated>"), day, F.lit("</updated></entry>"),
    )
    old = F.concat(F.lit("<item><title>R "), ident, F.lit("</title><link>"), link, F.lit('</link><dc:date>'), day, F.lit("</dc:date></item>"))
    item = F.when(kind == 1, atom).when(kind == 2, old).otherwise(rss)
    rows = table(spark, sf_dir, "events").select(F.floor(n / 20).alias("feed"), kind.alias("kind"), F.struct("event_id", item.alias("item")).alias("i"))
    joined = rows.groupBy("feed", "kind").agg(F.array_sort(F.collect_list("i")).alias("items"))
    body = F.array_join("items.item", "")
    xml = (
        F.when(F.col("kind") == 1, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), body, F.lit("</feed>")))
        .when(F.col("kind") == 2, F.concat(F.lit('<rdf:RDF xmlns:rdf="http://r" xmlns:dc="http://d"><channel><title>c</title></channel>'), body, F.lit("</rdf:RDF>")))
        .when(F.col("kind") == 3, F.concat(F.lit("<rss><channel>"), body))
        .otherwise(F.concat(F.lit("<rss><channel><title>c</title>"), body, F.lit("</channel></rss>")))
    )
    return joined.select("feed", xml.alias("xml"))


def many_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of up to thirty entries; some have no address, some a news date, some no date at all."""
    n = F.col("page_id")
    loc = F.when(n % 8 > 0, F.concat(F.lit("<loc>\n "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"))).otherwise("")
    dated = F.when(n % 3 == 0, F.concat(F.lit("<news:news><news:publication_date>"), _day("page_id").cast("string"), F.lit("</news:publication_date></news:news>"))).otherwise("")
    last = F.when(n % 5 > 0, "<lastmod>2024-06-01</lastmod>").otherwise("")
    entry = F.concat(F.lit("<url>"), loc, last, dated, F.lit("</url>"))
    rows = table(spark, sf_dir, "pages").select(F.floor(n / 30).alias("sitemap"), F.struct("page_id", entry.alias("entry")).alias("e"))
    joined = rows.groupBy("sitemap").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    xml = F.concat(F.lit('<urlset xmlns:news="http://example.com/news">'), F.array_join("entries.entry", "\n"), F.lit("</urlset>"))
    return joined.select("sitemap", xml.alias("xml"))


ANSWER = {
    "diario": None,
    "fecha": "",
    "seccion": "otra",
    "entidades": {
        "tipo_actor_principal": "@actor@",
        "empresas_mencionadas": ["YPF"],
        "sectores_mencionados": [],
    },
    "evento": {"tipo_evento": "@tipo@", "shock": "mixto", "caracter": "vigente", "horizonte_dias": "@dias@"},
    "mercado": {
        m: {"direccion": "@dir@", "magnitud": 0.5} for m in ("merval", "fx_ars", "tasa_bcra", "bonos_soberanos")
    },
    "optimismos": {
        o: 0.5
        for o in (
            "positividad_general", "apoyo_gobernanza", "optimismo_macro_corto",
            "optimismo_macro_largo", "optimismo_fin_corto", "optimismo_fin_largo",
        )
    },
    "tematicas": {
        f"menciona_{t}": "@tema@"
        for t in ("inflacion", "pbi", "reservas", "embi", "deuda", "fmi", "salarios_paritarias")
    },
    "calidad_fuente": {"categoria": "oficial", "calidad_fuente_score": "@puntaje@"},
    "confianza": "0.25",
    "evidencia": {"citas_evidencia": ["a", "b", "c"], "notas": "@notas@"},
}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a model answer made from their labels; unlabelled ones have a cut-off answer."""
    labels = table(spark, sf_dir, "labels")
    joined = news(spark, sf_dir).join(labels, "doc_id", "left")
    good = F.col("quality") == 1
    text = F.lit(json.dumps(ANSWER, ensure_ascii=False))
    marks = {
        "@actor@": F.when(good, "bcra").otherwise("unknown"),
        "@tipo@": F.when(good, "fiscal").otherwise("raro"),
        '"@dias@"': F.when(F.col("toxic") == 1, '"unknown"').otherwise(F.concat(F.lit('"'), F.length("contenido").cast("string"), F.lit('"'))),
        '"@dir@"': F.when(good, "-0.5").otherwise("7"),
        '"@tema@"': F.when(good, "true").otherwise('"false"'),
        '"@puntaje@"': F.when(good, "0.95").otherwise("0.1"),
        "@notas@": F.col("diario"),
    }
    for mark, value in marks.items():
        text = F.replace(text, F.lit(mark), value)
    cut = F.when(F.col("quality").isNull(), '{"diario": "x", "confianza": 0.').otherwise(text)
    return joined.select("doc_id", "diario", F.col("fecha").cast("string").alias("fecha"), "seccion", "url", cut.alias("response"))


# Fixed words the stand-in scorer looks for, one per topic.
STUB_WORDS = {"inflacion": "the", "pbi": "que", "reservas": "der", "embi": "los", "deuda": "and", "fmi": "les", "salarios_paritarias": "und"}


def load_stub_scorer():
    """A stand-in for a model: marks topics by a word and reports the length of the prompt."""

    def answer(prompt: str) -> str:
        lower = prompt.lower()
        record = json.loads(json.dumps(ANSWER))
        record["tematicas"] = {f"menciona_{t}": f" {w} " in lower for t, w in STUB_WORDS.items()}
        record["evento"]["horizonte_dias"] = len(prompt)
        return json.dumps(record)

    return lambda prompts: [answer(p) for p in prompts]


def load_failing_scorer():
    """The stand-in scorer, failing on articles in German."""
    score = load_stub_scorer()

    def ask(prompts: list[str]) -> list[str]:
        if any("\nSeccion: de\n" in p for p in prompts):
            raise ValueError("no answer")
        return score(prompts)

    return ask


def load_no_scorer():
    """A model that cannot be reached."""

    def ask(prompts: list[str]) -> list[str]:
        raise ConnectionError("no model")

    return ask


# Letters that the stand-in encoder looks for.
STUB_LETTERS = "aeinrstu"


def load_letter_encoder():
    """One for every text, then one for each of the letters it has."""
    return lambda texts: [[1.0, *(float(letter in text) for letter in STUB_LETTERS)] for text in texts]
