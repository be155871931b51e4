"""Names, word lists and formats that results depend on."""

# Spanish month names and their numbers.
MONTHS_ES = {
    "enero": 1,
    "febrero": 2,
    "marzo": 3,
    "abril": 4,
    "mayo": 5,
    "junio": 6,
    "julio": 7,
    "agosto": 8,
    "septiembre": 9,
    "octubre": 10,
    "noviembre": 11,
    "diciembre": 12,
}

# Time zone of the feeds, study window, days dropped at its border.
LOCAL_ZONE = "America/Argentina/Buenos_Aires"
WINDOW_START = "2025-01-01"
WINDOW_END = "2025-04-30"
BORDER_DAYS = ["2024-12-30", "2024-12-31", "2025-05-01"]

# Text that stands for "missing" in the scraped tables.
NO_DATE = "Fecha no encontrada"
NO_TITLE = "Título no encontrado"
NO_BODY = "Contenido no encontrado"
NO_MASC = "No encontrado"
NO_FEM = "No encontrada"
SENTINELS = [NO_DATE, NO_TITLE, NO_BODY, NO_MASC, NO_FEM]

# Canonical and per-source column lists.
NEWS_COLUMNS = ["diario", "fecha", "titulo", "contenido", "url", "seccion"]
RSS_COLUMNS = ["date", "published_at_local", "source", "rank_in_source", "title", "link"]
EDA_REQUIRED = ["id", "seccion", "fecha_publicacion", "titulo", "url"]
SITEMAP_ARTICLE_COLUMNS = ["id", "seccion", "fecha_publicacion", "titulo", "url"]
SITEMAP_ARTICLE_OPTIONAL = ["bajada", "texto", "status"]

# Papers and the feeds read for each, in reading order.
FEEDS = {
    "La Nación": [
        "https://www.lanacion.com.ar/rss/tema/ultimas-noticias.xml",
        "https://www.lanacion.com.ar/rss/canalpolitica.xml",
        "https://www.lanacion.com.ar/rss/canaleconomia.xml",
    ],
    "Clarín": [
        "https://www.clarin.com/rss/lo-ultimo/",
        "https://www.clarin.com/rss/politica/",
        "https://www.clarin.com/rss/economia/",
    ],
    "Página/12": [
        "https://www.pagina12.com.ar/rss/portada",
        "https://www.pagina12.com.ar/rss/secciones/el-pais",
        "https://www.pagina12.com.ar/rss/secciones/economia",
    ],
    "Infobae": [
        "https://www.infobae.com/feeds/rss/",
        "https://www.infobae.com/america/rss.xml",
    ],
    "Ámbito": [
        "https://www.ambito.com/rss/ultimas-noticias.xml",
        "https://www.ambito.com/rss/economia.xml",
    ],
}

# Allowed answers of the feature record.
ENUMS = {
    "entidades.tipo_actor_principal": [
        "gobierno_nacional",
        "bcra",
        "provincia",
        "municipio",
        "empresa_mercado_local",
        "empresa_mercado_ext",
        "sindicato",
        "poder_judicial",
        "congreso",
        "organismo_internacional",
        "desconocido",
    ],
    "evento.tipo_evento": [
        "monetario",
        "fiscal",
        "regulatorio",
        "corporativo",
        "externo",
        "sindical_social",
        "judicial",
        "electoral",
        "otro",
        "desconocido",
    ],
    "evento.shock": ["positivo", "negativo", "mixto", "neutro", "desconocido"],
    "evento.caracter": ["retroactivo", "vigente", "prospectivo", "desconocido"],
    "calidad_fuente.categoria": [
        "oficial",
        "periodistica",
        "rumor",
        "analisis",
        "desconocido",
    ],
}

# Score bands asked for each source category.
QUALITY_BANDS = {
    "oficial": (0.9, 1.0),
    "periodistica": (0.6, 0.8),
    "analisis": (0.5, 0.7),
    "rumor": (0.2, 0.4),
}

# Longest article text put into a prompt, and most quotes allowed.
PROMPT_CHARS = 8000
MAX_QUOTES = 3
