"""DuckDB SQL that computes what each query must return, straight from the test tables."""

from __future__ import annotations

from rotativa.operators.features import USER_PROMPT
from rotativa.plans.driver_tables import ANSWER, STUB_LETTERS, STUB_WORDS

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = _SPACE.replace("[", "[^", 1)

_NEWS = """
news AS (
  SELECT doc_id, source AS diario, lang AS seccion,
         DATE '2024-12-30' + CAST(doc_id % 124 AS INT) AS fecha,
         trim(split_part(text, '.', 1)) AS titulo, text AS contenido,
         'https://www.example.com/' || lang || '/nota-' || md5(text) || '-nid' || n_chars || '/' AS url,
         doc_id // 11 AS pagina, doc_id AS pos
  FROM documents)"""

_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
_MESES = (
    "['enero','febrero','marzo','abril','mayo','junio',"
    "'julio','agosto','septiembre','octubre','noviembre','diciembre']"
)

_ENTRIES = f"""
entries AS (
  SELECT event_type AS source, event_id AS entry_pos, props AS title,
         'https://example.com/e/' || event_id AS link,
         CASE event_type
           WHEN 'error' THEN NULL
           WHEN 'view' THEN day(ts) || ' ' || {_MONTHS}[month(ts)] || ' ' || year(ts) || strftime(ts, ' %H:%M:%S GMT')
           WHEN 'click' THEN day(ts) || ' ' || {_MONTHS}[month(ts)] || ' ' || year(ts) || strftime(ts, ' %H:%M:%S -0300')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS published,
         date_trunc('second', CASE event_type
           WHEN 'error' THEN TIMESTAMP '2024-01-31 21:00:00'
           WHEN 'click' THEN ts ELSE ts - INTERVAL 3 HOUR END) AS local_at
  FROM events)"""

_RSS_TOP = f"""
WITH {_ENTRIES},
first_titles AS (
  SELECT * FROM entries WHERE trim(title) <> ''
  QUALIFY row_number() OVER (PARTITION BY source, lower(trim(title)) ORDER BY entry_pos) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY local_at DESC, entry_pos) AS rank_in_source FROM first_titles)
SELECT strftime(local_at, '%Y-%m-%d') AS date, strftime(local_at, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS published_at_local,
       source, rank_in_source, title, link
FROM ranked WHERE rank_in_source <= 10"""


def _text(html: str, separator: str = "''") -> str:
    """Stripped, unescaped text nodes of an HTML fragment, joined."""
    nodes = f"string_split(regexp_replace({html}, '<[^>]*>', chr(1), 'g'), chr(1))"
    plain = (
        "replace(replace(replace(replace(x, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    )
    cleaned = f"list_transform({nodes}, lambda x: regexp_replace({plain}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    return f"array_to_string(list_filter({cleaned}, lambda x: x <> ''), {separator})"


_BARE = """
bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs') AS html
  FROM (SELECT page_id, url, regexp_replace(html, '<!--.*?-->', chr(1), 'gs') AS html FROM pages))"""

# Paragraphs end at their end tag, at the next paragraph or at the end of the article.
_PARAGRAPHS = f"""
{_BARE},
pieces AS (
  SELECT page_id, url, string_split(html, '<p>')[2:] AS parts FROM bare),
paragraphs AS (
  SELECT page_id, url, i, split_part(split_part(parts[i], '</p>', 1), '</article>', 1) AS inner_html
  FROM pieces, unnest(range(1, len(parts) + 1)) AS u(i))"""

_LONG = f"""
long_ones AS (
  SELECT page_id, url, i, parrafo FROM (
    SELECT page_id, url, i, {_text('inner_html', "' '")} AS parrafo FROM paragraphs) WHERE length(parrafo) > 40)"""

_H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
_PAGE_DAY = "(DATE '2024-12-30' + CAST(page_id % 124 AS INT))"

_VECTORS = """
vectors AS (
  SELECT vec_id, CAST(label AS BIGINT) AS fecha_dia,
         CASE WHEN vec_id % 2 = 0 THEN 'politica' ELSE 'economia' END AS seccion, embedding
  FROM embeddings)"""


def _mean_rows(keys: str) -> str:
    return f"""
WITH {_VECTORS},
parts AS (
  SELECT {keys}, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM vectors)
SELECT {keys}, count(*) AS count_noticias, i::BIGINT AS i, round(avg(x), 6) AS x FROM parts GROUP BY {keys}, i"""


def _unit_terms(rows: str) -> str:
    """Unit tf-idf weights of the terms of ``rows`` (node, text)."""
    return f"""
words AS (SELECT node, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {rows}),
counted AS (SELECT node, term, count(*) AS tf FROM words GROUP BY ALL),
often AS (SELECT term, count(*) AS df FROM counted GROUP BY ALL),
raw AS (
  SELECT node, term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM {rows})) / (1 + df)::DOUBLE)) AS w
  FROM counted JOIN often USING (term)),
unit AS MATERIALIZED (SELECT node, term, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS w FROM raw)"""


def _hashed_terms(rows: str, dims: int) -> str:
    """Unit vectors (node, at, x) of hashed terms, without zeros."""
    return f"""{_unit_terms(rows)},
hashed AS (
  SELECT node, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dims} AS place, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN w ELSE -w END) AS x
  FROM unit GROUP BY ALL),
vectors AS MATERIALIZED (SELECT node, place, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM hashed)"""


_DETECTED = f"""
{_NEWS},
triples AS (
  SELECT doc_id, seccion, unnest(flatten([[substr(w, i, 3) FOR i IN range(1, length(w) - 1)] FOR w IN
    ['_' || v || '_' FOR v IN regexp_extract_all(lower(coalesce(contenido, '')), '\\p{{L}}+')]])) AS triple
  FROM news),
known AS (
  SELECT seccion AS language, triple, 301 - row_number() OVER (PARTITION BY seccion ORDER BY count(*) DESC, triple) AS gain
  FROM triples WHERE doc_id % 3 <> 1 AND seccion IS NOT NULL GROUP BY seccion, triple QUALIFY gain > 0),
gains AS (SELECT doc_id, language, sum(gain) AS gain FROM triples JOIN known USING (triple) GROUP BY ALL),
best AS (SELECT doc_id, language FROM gains QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, language) = 1),
detected AS (SELECT doc_id, fecha, language AS idioma FROM news LEFT JOIN best USING (doc_id))"""


_TARGET = f"""
{_NEWS},
market AS (
  SELECT DATE '2024-12-30' + CAST(o_orderkey % 124 AS INT) AS fecha, round(avg(o_totalprice), 4) AS cierre FROM orders GROUP BY 1
  HAVING dayofweek(DATE '2024-12-30' + CAST(o_orderkey % 124 AS INT)) NOT IN (0, 6)),
daily AS (SELECT fecha, count(*) AS n_noticias, avg(length(contenido)) AS largo FROM news GROUP BY fecha),
target AS (
  SELECT d.*, p.cierre AS cierre_previo, q.cierre AS cierre_siguiente FROM daily d
  ASOF LEFT JOIN market p ON d.fecha >= p.fecha ASOF LEFT JOIN market q ON d.fecha < q.fecha)"""


def _ridge(rows: str, by: str) -> str:
    """Penalised least squares of y on x and z per group, written out for two features."""
    return f"""
means AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM {rows} GROUP BY {by}),
moments AS (
  SELECT {by}, sum((x - mx) * (x - mx)) + 1 AS xx, sum((z - mz) * (z - mz)) + 1 AS zz, sum((x - mx) * (z - mz)) AS xz,
         sum((x - mx) * (y - my)) AS xy, sum((z - mz) * (y - my)) AS zy
  FROM {rows} JOIN means USING ({by}) GROUP BY {by}),
slopes AS (SELECT {by}, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM moments),
fitted AS (SELECT {by}, n, my, bx, bz, my - bx * mx - bz * mz AS b0 FROM means JOIN slopes USING ({by}))"""


def _topics(rounds: int = 4, k: int = 3) -> str:
    """Multiplicative updates of the factors of days and title terms, round by round."""
    names = [f"t{i}" for i in range(k)]
    start = lambda key: ", ".join(f"('0x' || substr(md5('{i}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE + 0.5 AS t{i}" for i in range(k))
    steps = [f"""
{_NEWS},
cells AS MATERIALIZED (
  SELECT "row", col, count(*)::DOUBLE AS x FROM (
    SELECT CAST(fecha AS VARCHAR) AS "row", unnest(regexp_extract_all(lower(coalesce(titulo, '')), '[\\p{{L}}\\p{{N}}]+')) AS col FROM news)
  GROUP BY 1, 2),
row_0 AS MATERIALIZED (SELECT "row", {start('"row"')} FROM (SELECT DISTINCT "row" FROM cells)),
col_0 AS MATERIALIZED (SELECT col, {start("col")} FROM (SELECT DISTINCT col FROM cells))"""]
    for r in range(rounds):
        for key, other, old_other in (("col", "row", f"row_{r}"), ("row", "col", f"col_{r + 1}")):
            quoted, by = ('"row"', "col") if key == "row" else ("col", '"row"')
            gram = ", ".join(f"sum({a} * {b}) AS g_{a}_{b}" for a in names for b in names)
            new = ", ".join(f"s.{a} * n_{a} / greatest({' + '.join(f'g_{a}_{b} * s.{b}' for b in names)}, 1e-12) AS {a}" for a in names)
            sums = ", ".join(f"sum(x * o.{a}) AS n_{a}" for a in names)
            steps.append(f"""{key}_{r + 1} AS MATERIALIZED (
  SELECT s.{quoted}, {new} FROM {key}_{r} s JOIN (SELECT c.{quoted}, {sums} FROM cells c JOIN {old_other} o ON c.{by} = o.{by} GROUP BY 1) n
    ON s.{quoted} = n.{quoted}, (SELECT {gram} FROM {old_other}) g)""")
    return ",\n".join(steps)


def _long(table: str, key: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {i} AS topic, {value.format(t=f't{i}')} AS w FROM {table}" for i in range(3))


_ASKED = f"""
{_NEWS},
given AS (
  SELECT doc_id, fecha, doc_id % 17 = 0 AS unread,
         CASE doc_id % 4 WHEN 0 THEN 'alcista' WHEN 1 THEN 'bajista' END AS trend, doc_id % 4 = 3 AS no_trend,
         length(contenido) % 130 AS sube, (doc_id % 6) * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS impact, doc_id % 3 AS abroad
  FROM news),
answers AS (
  SELECT doc_id, fecha, 'tendencia' AS question, 'choice' AS kind, NULL::DOUBLE AS value, CASE WHEN NOT unread THEN trend END AS label,
         CASE WHEN unread THEN 'unreadable' WHEN no_trend THEN 'missing' WHEN trend IS NULL THEN 'type' END AS violation FROM given
  UNION ALL
  SELECT doc_id, fecha, 'sube', 'number', CASE WHEN NOT unread AND sube <= 100 THEN sube END, NULL,
         CASE WHEN unread THEN 'unreadable' WHEN sube > 100 THEN 'range' END FROM given
  UNION ALL
  SELECT doc_id, fecha, 'mineria', 'impact', CASE WHEN NOT unread AND abs(impact) <= 3 THEN impact END,
         CASE WHEN NOT unread AND abs(impact) <= 3 THEN CASE sign(impact) WHEN 1 THEN 'positivo' WHEN -1 THEN 'negativo' ELSE 'neutro' END END,
         CASE WHEN unread THEN 'unreadable' WHEN abs(impact) > 3 THEN 'range' END FROM given
  UNION ALL
  SELECT doc_id, fecha, 'exterior', 'flag', CASE WHEN NOT unread THEN CASE abroad WHEN 0 THEN 1 WHEN 1 THEN 0 END END, NULL,
         CASE WHEN unread THEN 'unreadable' WHEN abroad = 2 THEN 'type' END FROM given)"""


_VARIED = f"""
{_NEWS},
varied AS (
  SELECT *, doc_id % 7 NOT IN (0, 1) AS read, doc_id % 11 > 0 AS there, CAST(fecha AS VARCHAR) AS dia FROM news)"""


_ANSWERED = """
answered AS (
  SELECT n.*, l.quality, l.toxic, l.quality = 1 AS good FROM news n LEFT JOIN labels l USING (doc_id))"""


def _user_prompt() -> str:
    template = USER_PROMPT.replace("'", "''")
    parts = {
        "{diario}": "coalesce(diario, 'unknown')",
        "{fecha}": "coalesce(CAST(fecha AS VARCHAR), 'unknown')",
        "{seccion}": "coalesce(seccion, 'unknown')",
        "{titulo}": "coalesce(titulo, 'unknown')",
        "{url}": "coalesce(url, 'unknown')",
        "{contenido}": "substring(coalesce(contenido, ''), 1, 8000)",
    }
    sql = f"'{template}'"
    for mark, value in parts.items():
        sql = sql.replace(mark, f"' || {value} || '")
    return sql


def _violations(low_good: bool) -> str:
    """Comma list of the violations of a labelled answer."""
    if low_good:
        found = []
    else:
        markets = ["bonos_soberanos", "fx_ars", "merval", "tasa_bcra"]
        found = ["enum:entidades.tipo_actor_principal", "enum:evento.tipo_evento", "quality_band"]
        found += [f"range:mercado.{m}.direccion" for m in markets]
    return ",".join(sorted(found))


def _flat_columns() -> str:
    good = "good"
    columns = {
        "diario": "diario",
        "fecha": "CAST(fecha AS VARCHAR)",
        "seccion": "'otra'",
        "url": "url",
        "entidades__tipo_actor_principal": f"CASE WHEN {good} THEN 'bcra' ELSE 'desconocido' END",
        "entidades__nombre_actor_principal": "'unknown'",
        "entidades__empresas_mencionadas": "'YPF'",
        "entidades__tickers_mencionados": "''",
        "entidades__sectores_mencionados": "''",
        "evento__tipo_evento": f"CASE WHEN {good} THEN 'fiscal' ELSE 'desconocido' END",
        "evento__shock": "'mixto'",
        "evento__caracter": "'vigente'",
        "evento__horizonte_dias": "CASE WHEN toxic = 1 THEN NULL ELSE length(contenido) END",
        "calidad_fuente__categoria": "'oficial'",
        "calidad_fuente__calidad_fuente_score": f"CASE WHEN {good} THEN 0.95::DOUBLE ELSE 0.1::DOUBLE END",
        "confianza": "0.25::DOUBLE",
        "evidencia__citas_evidencia": "'a|b|c'",
        "evidencia__notas": "diario",
    }
    for market in ANSWER["mercado"]:
        columns[f"mercado__{market}__direccion"] = f"CASE WHEN {good} THEN -0.5::DOUBLE ELSE 7::DOUBLE END"
        columns[f"mercado__{market}__magnitud"] = "0.5::DOUBLE"
    for outlook in ANSWER["optimismos"]:
        columns[f"optimismos__{outlook}"] = "0.5::DOUBLE"
    for topic in ANSWER["tematicas"]:
        columns[f"tematicas__{topic}"] = good
    # A cut-off answer leaves the article's own metadata and the repaired defaults.
    cut = {
        "seccion": "seccion",
        "entidades__tipo_actor_principal": "'desconocido'",
        "entidades__nombre_actor_principal": "'unknown'",
        **{f"entidades__{x}": "''" for x in ("empresas_mencionadas", "tickers_mencionados", "sectores_mencionados")},
        **{f"evento__{x}": "'desconocido'" for x in ("tipo_evento", "shock", "caracter")},
        "calidad_fuente__categoria": "'desconocido'",
    }
    same = ("diario", "fecha", "url")
    pairs = {n: v if n in same else f"CASE WHEN quality IS NULL THEN {cut.get(n, 'NULL')} ELSE {v} END" for n, v in columns.items()}
    return ", ".join(f"{value} AS {name}" for name, value in pairs.items())


def _all_missing() -> str:
    """What an unreadable answer lacks: every leaf that must be there."""
    optional = {"diario", "fecha", "seccion", "evento.horizonte_dias", "evidencia.notas", "entidades.empresas_mencionadas", "entidades.sectores_mencionados"}

    def leaves(part, prefix=""):
        for name, value in part.items():
            if isinstance(value, dict):
                yield from leaves(value, f"{prefix}{name}.")
            elif prefix + name not in optional:
                yield f"missing:{prefix}{name}"

    return ",".join(sorted(leaves(ANSWER)))


_EVENT_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
_FIRST_URL = "QUALIFY row_number() OVER (PARTITION BY url ORDER BY pagina, pos) = 1"
_STORED = "stored AS (SELECT DISTINCT url FROM news WHERE fecha < DATE '2025-02-01')"
_UNSEEN = f"unseen AS (SELECT * FROM (SELECT * FROM news {_FIRST_URL}) ANTI JOIN stored USING (url))"

def _pca(keys: str, columns: str, squarings: int = 16) -> str:
    """First two principal components of group means, from the Gram matrix of the centred means.

    Squaring the matrix again and again leaves the projection on its largest eigenvector; the
    second one is found in the same way after taking the first away.
    """

    def largest(name: str, gram: str) -> str:
        steps = [f"{name}_0 AS MATERIALIZED (SELECT a, b, x / (SELECT sum(x) FROM {gram} WHERE a = b) AS x FROM {gram})"]
        for k in range(squarings):
            steps.append(
                f"{name}_{k + 1} AS MATERIALIZED (SELECT p.a, q.b, sum(p.x * q.x) / (SELECT sum(x * x) FROM {name}_{k}) AS x "
                f"FROM {name}_{k} p JOIN {name}_{k} q ON p.b = q.a GROUP BY 1, 2)"
            )
        last = f"{name}_{squarings}"
        steps.append(
            f"{name} AS MATERIALIZED (SELECT a, x / sqrt((SELECT max(x) FROM {last} WHERE a = b)) AS u FROM {last} "
            f"WHERE b = (SELECT a FROM {last} WHERE a = b ORDER BY x DESC, a LIMIT 1))"
        )
        steps.append(f"{name}_size AS (SELECT sum(g.x * p.u * q.u) AS s FROM {gram} g JOIN {name} p ON g.a = p.a JOIN {name} q ON g.b = q.a)")
        steps.append(f"{name}_sign AS (SELECT sign(l) AS s FROM (SELECT sum(u * c.x) AS l FROM {name} JOIN centred c USING (a) GROUP BY i) ORDER BY abs(l) DESC LIMIT 1)")
        return ", ".join(steps)

    return f"""
WITH {_VECTORS},
parts AS (SELECT {keys}, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM vectors),
means AS (SELECT {keys}, i, avg(x) AS x, dense_rank() OVER (ORDER BY {keys}) AS a FROM parts GROUP BY {keys}, i),
centred AS MATERIALIZED (SELECT a, i, x - avg(x) OVER (PARTITION BY i) AS x FROM means),
gram AS MATERIALIZED (SELECT p.a, q.a AS b, sum(p.x * q.x) AS x FROM centred p JOIN centred q USING (i) GROUP BY 1, 2),
{largest("one", "gram")},
rest AS MATERIALIZED (
  SELECT g.a, g.b, g.x - (SELECT s FROM one_size) * p.u * q.u AS x FROM gram g JOIN one p ON g.a = p.a JOIN one q ON g.b = q.a),
{largest("two", "rest")},
counts AS (SELECT {keys}, count(*) AS count_noticias FROM vectors GROUP BY {keys}),
named AS (SELECT DISTINCT {keys}, a FROM means)
SELECT {columns},
       round(one.u * sqrt((SELECT s FROM one_size)) * (SELECT s FROM one_sign), 6) AS pc1,
       round(two.u * sqrt((SELECT s FROM two_size)) * (SELECT s FROM two_sign), 6) AS pc2
FROM named JOIN counts USING ({keys}) JOIN one USING (a) JOIN two USING (a)"""


ORACLE = {
    "q_articles_per_day": f"""
WITH {_NEWS}
SELECT CAST(fecha AS VARCHAR) AS fecha, diario, count(*) AS n FROM news
WHERE fecha BETWEEN DATE '2025-01-01' AND DATE '2025-04-30' GROUP BY 1, 2""",
    "q_date_window": f"""
WITH {_NEWS}
SELECT doc_id, CAST(fecha AS VARCHAR) AS fecha, diario, titulo FROM news
WHERE fecha BETWEEN DATE '2025-01-01' AND DATE '2025-04-30'""",
    "q_not_in": f"""
WITH {_NEWS}
SELECT doc_id, CAST(fecha AS VARCHAR) AS fecha, diario FROM news
WHERE fecha NOT IN (DATE '2024-12-30', DATE '2024-12-31', DATE '2025-05-01')""",
    "q_bad_dates": f"""
WITH {_NEWS}
SELECT diario, count(*) AS n, CASE WHEN seccion = 'de' THEN 'bad' ELSE 'good' END AS parte FROM news GROUP BY 1, 3""",
    "q_local_day": """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS dia_offset, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS dia_z FROM events""",
    "q_written_day": """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS dia_offset, strftime(ts, '%Y-%m-%d') AS dia_z FROM events""",
    "q_utc_day": """
SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS dia_offset, strftime(ts, '%Y-%m-%d') AS dia_z FROM events""",
    "q_publication_iso": f"""
SELECT event_id, {_EVENT_TEXT} || '-03:00' AS dia_offset, {_EVENT_TEXT} || '+00:00' AS dia_z FROM events""",
    "q_feed_dates": f"""
WITH {_ENTRIES}
SELECT entry_pos, strftime(local_at, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS published_at_local,
       CASE WHEN published IS NULL THEN 'Fecha no encontrada' WHEN source IN ('view', 'click') THEN published
            ELSE published[:10] END AS written
FROM entries""",
    "q_spanish_dates": f"""
WITH spelt AS (
  SELECT o_orderkey, day(o_orderdate) || ' de ' || {_MESES}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' - ' ||
         lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS t
  FROM orders),
split AS (SELECT o_orderkey, regexp_extract(t, '(\\d+) de ([a-z]+) (\\d+) - (\\d+:\\d+)', ['d', 'm', 'y', 'c']) AS p FROM spelt)
SELECT o_orderkey, p.y || '-' || lpad(CAST(list_position({_MESES}, p.m) AS VARCHAR), 2, '0') || '-' || lpad(p.d, 2, '0') ||
       ' ' || p.c || ':00' AS fecha
FROM split""",
    "q_month_overlap": f"""
WITH {_NEWS}
SELECT strftime(fecha, '%Y-%m') AS mes, count(*) AS n, CAST(min(date_trunc('month', fecha)::DATE) AS VARCHAR) AS desde,
       CAST(max(last_day(fecha)) AS VARCHAR) AS hasta
FROM news WHERE last_day(fecha) >= DATE '2025-02-10' AND date_trunc('month', fecha) <= DATE '2025-03-05' GROUP BY 1""",
    "q_month_windows": f"""
WITH {_NEWS},
windows AS (SELECT seccion AS ventana, min(fecha) + 40 AS s, max(fecha) - 35 AS e FROM news GROUP BY 1),
months AS (SELECT date_trunc('month', fecha)::DATE AS mes, count(*) AS n FROM news GROUP BY 1)
SELECT ventana, CAST(mes AS VARCHAR) AS mes, n FROM months, windows WHERE last_day(mes) >= s AND mes <= e""",
    "q_consolidate": f"""
WITH {_NEWS}
SELECT CASE seccion WHEN 'de' THEN 'Ámbito Financiero' WHEN 'en' THEN 'Clarín' WHEN 'es' THEN 'La Nación' ELSE 'Pagina 12' END AS diario,
       CAST(fecha AS VARCHAR) AS fecha, titulo, contenido, url,
       CASE seccion WHEN 'de' THEN 'opinion' WHEN 'es' THEN 'es' ELSE 'economia' END AS seccion
FROM news WHERE fecha BETWEEN DATE '2025-01-01' AND DATE '2025-04-30'""",
    "q_schema_report": f"""
WITH findings(source, lang, "column", kind) AS (VALUES
  ('ambito', 'de', 'diario', 'missing'), ('ambito', 'de', 'contenido', 'missing'),
  ('ambito', 'de', 'resumen', 'extra'), ('ambito', 'de', 'articulo', 'extra'),
  ('clarin', 'en', 'titulo', 'missing'), ('clarin', 'en', 'url', 'missing'), ('clarin', 'en', 'seccion', 'missing'),
  ('clarin', 'en', 'titulo noticia', 'extra'), ('clarin', 'en', 'link', 'extra'),
  ('lanacion', 'es', 'diario', 'missing'), ('lanacion', 'es', 'fecha', 'missing'), ('lanacion', 'es', 'contenido', 'missing'),
  ('lanacion', 'es', 'id', 'extra'), ('lanacion', 'es', 'fecha_publicacion', 'extra'), ('lanacion', 'es', 'bajada', 'extra'),
  ('lanacion', 'es', 'texto', 'extra'), ('lanacion', 'es', 'status', 'extra'),
  ('pagina12', 'fr', 'titulo', 'missing'), ('pagina12', 'fr', 'url', 'missing'), ('pagina12', 'fr', 'seccion', 'missing'),
  ('pagina12', 'fr', 'titulo noticia', 'extra'), ('pagina12', 'fr', 'link', 'extra')),
sizes AS (SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1)
SELECT source, "column", kind, n_rows FROM findings JOIN sizes USING (lang)""",
    "q_profile": f"""
WITH {_NEWS}, totals AS (SELECT count(*) AS n, count(CASE WHEN seccion <> 'de' THEN 1 END) AS t FROM news)
SELECT unnest(['id', 'seccion', 'fecha_publicacion', 'titulo', 'url', 'bajada', 'texto']) AS "column", 'string' AS "type",
       unnest([n, n, n, n, n, n, t]) AS non_null, n AS n_rows FROM totals""",
    "q_count_by_source": "SELECT source AS diario, count(*) AS n FROM documents GROUP BY 1",
    "q_count_by_section": "SELECT lang AS seccion, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1",
    "q_count_by_date": f"WITH {_NEWS} SELECT CAST(fecha AS VARCHAR) AS fecha, count(*) AS n FROM news GROUP BY 1",
    "q_daily_counts": f"WITH {_NEWS} SELECT CAST(fecha + 1 AS VARCHAR) AS fecha_dia, count(*) AS count_noticias FROM news GROUP BY 1",
    "q_daily_nunique": f"""
WITH {_NEWS}
SELECT CAST(fecha + 1 AS VARCHAR) AS fecha_dia, count(DISTINCT regexp_extract(url, '-nid(\\d+)', 1)) AS n_ids FROM news GROUP BY 1""",
    "q_lengths": f"""
SELECT doc_id, length(text) AS len_chars, len(regexp_extract_all(text, '{_WORD}+')) AS len_words FROM documents""",
    "q_len_hist": """
WITH lengths AS (SELECT length(text)::DOUBLE AS x FROM documents),
span AS (SELECT min(x) AS lo, max(x) AS hi FROM lengths),
counts AS (SELECT least(floor((x - lo) * 40 / (hi - lo)), 39)::BIGINT AS bin, count(*) AS n FROM lengths, span GROUP BY 1)
SELECT b.bin, round(lo + (hi - lo) * b.bin / 40, 6) AS left_edge, round(lo + (hi - lo) * (b.bin + 1) / 40, 6) AS right_edge,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(40))::BIGINT AS bin) b CROSS JOIN span LEFT JOIN counts USING (bin)""",
    "q_clean_text": f"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS limpio FROM documents",
    "q_base_text": f"""
WITH {_NEWS}
SELECT doc_id, CASE WHEN seccion = 'de' THEN '' ELSE contenido END AS texto_base,
       CASE WHEN seccion = 'de' THEN regexp_replace(titulo || ' bajada', '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE contenido END AS texto_fila
FROM news""",
    "q_eda_prepared": f"""
WITH {_NEWS}, base AS (SELECT *, CASE WHEN seccion = 'de' THEN '' ELSE contenido END AS t FROM news)
SELECT doc_id, seccion, CAST(fecha + 1 AS VARCHAR) AS fecha_dia, length(t) AS len_chars,
       len(regexp_extract_all(t, '{_WORD}+')) AS len_words
FROM base""",
    "q_title_dedup": f"""
WITH {_NEWS}
SELECT doc_id, diario, titulo FROM news WHERE trim(titulo) <> ''
QUALIFY row_number() OVER (PARTITION BY diario, lower(trim(titulo)) ORDER BY doc_id) = 1""",
    "q_url_dedup": f"WITH {_NEWS} SELECT doc_id, url FROM news {_FIRST_URL}",
    "q_rss_topn": _RSS_TOP,
    "q_top_large": """
SELECT doc_id, lang AS seccion, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank
FROM documents QUALIFY rank <= 5000""",
    "q_source_filter": "SELECT source AS diario, count(*) AS n FROM documents WHERE source IN ('src3', 'src7') GROUP BY 1",
    "q_source_semi": """
SELECT doc_id, source AS diario FROM documents
WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id))""",
    "q_seen_urls": f"WITH {_NEWS} SELECT DISTINCT url FROM news",
    "q_new_urls": f"WITH {_NEWS}, {_STORED}, {_UNSEEN} SELECT doc_id, url FROM unseen",
    "q_page_progress": f"""
WITH {_NEWS}, {_STORED}, {_UNSEEN},
per_page AS (SELECT pagina, count(*) AS n_nuevas, min_by(fecha, pos) AS f FROM unseen GROUP BY 1)
SELECT pagina, n_nuevas, CAST(f AS VARCHAR) AS primera_fecha,
       CAST(sum(n_nuevas) OVER (ORDER BY pagina) AS BIGINT) + (SELECT count(*) FROM stored) AS total_urls
FROM per_page""",
    "q_page_cutoff": """
WITH firsts AS (SELECT doc_id // 11 AS pagina, DATE '2025-06-30' - CAST(doc_id // 11 AS INT) AS f FROM documents GROUP BY 1, 2),
flagged AS (
  SELECT pagina, coalesce(max(f < DATE '2025-05-01') OVER (ORDER BY pagina ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped
  FROM firsts)
SELECT doc_id, pagina FROM documents JOIN flagged ON doc_id // 11 = pagina WHERE NOT stopped""",
    "q_append_new": f"""
WITH {_NEWS}, {_STORED}, {_UNSEEN}
SELECT doc_id, url FROM news WHERE fecha < DATE '2025-02-01' UNION ALL SELECT doc_id, url FROM unseen""",
    "q_sample_n": f"""
WITH {_NEWS} SELECT doc_id, diario, titulo FROM news ORDER BY sha256('42:' || doc_id), doc_id LIMIT 10""",
    "q_first_n": f"""
WITH {_NEWS} SELECT doc_id, CAST(fecha AS VARCHAR) AS fecha FROM (SELECT * FROM news ORDER BY fecha DESC, doc_id LIMIT 20)""",
    "q_url_section": f"""
SELECT page_id, {_PATH} AS ruta, nullif(split_part(ltrim({_PATH}, '/'), '/', 1), '') AS seccion FROM pages
WHERE starts_with(url, 'https://') AND (contains(lower({_PATH}), '/en/') OR contains(lower({_PATH}), '/es/'))""",
    "q_nid": "SELECT doc_id, CAST(n_chars AS VARCHAR) AS id FROM documents",
    "q_feed_entries": f"""
WITH {_ENTRIES}
SELECT source, entry_pos AS feed_pos, CAST(0 AS BIGINT) AS entry_pos, title, link, published FROM entries""",
    "q_feed_top": _RSS_TOP,
    "q_sitemap_urls": f"""
SELECT 'https://www.example.com/sitemap-' || page_id AS sitemap_url, CAST(0 AS BIGINT) AS pos, url,
       CASE WHEN page_id % 2 = 1 THEN CAST({_PAGE_DAY} AS VARCHAR) ELSE '2024-06-01' END AS lastmod
FROM pages""",
    "q_sitemap_index": f"""
WITH {_NEWS}
SELECT DISTINCT 'https://www.example.com/sitemap-' || strftime(fecha, '%Y-%m') || '.xml' AS loc FROM news
WHERE last_day(fecha) >= DATE '2025-02-10' AND date_trunc('month', fecha) <= DATE '2025-03-05'
UNION SELECT 'https://www.example.com/sitemap-' || page_id FROM pages
UNION SELECT 'https://www.example.com/sitemap-news.xml'""",
    "q_links": f"""
WITH anchors AS (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1, 's') AS hrefs,
         regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2, 's') AS labels
  FROM pages),
one AS (SELECT page_id, url, i, hrefs[i] AS href, labels[i] AS label FROM anchors, unnest(range(1, len(hrefs) + 1)) AS u(i))
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, {_text('label')} AS title,
       CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href END AS link
FROM one""",
    "q_listing_links": f"""
WITH anchors AS (
  SELECT page_id, regexp_extract_all(html, '<li>.*?<a href="([^"]*)">(.*?)</a>', 1, 's') AS hrefs,
         regexp_extract_all(html, '<li>.*?<a href="([^"]*)">(.*?)</a>', 2, 's') AS labels
  FROM pages),
one AS (SELECT page_id, i, hrefs[i] AS href, labels[i] AS label FROM anchors, unnest(range(1, len(hrefs) + 1)) AS u(i))
SELECT page_id AS pagina, CAST(i - 1 AS BIGINT) AS pos, {_text('label')} AS title,
       CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://www.example.com' || href END AS link
FROM one""",
    "q_article_extract": f"""
WITH {_BARE}
SELECT page_id, {_text(_TITLE)} AS titulo, {_text(_H1)} AS h1,
       len(string_split(html, '<p>')) - 1 AS n_parrafos, len(string_split(html, '<a ')) - 1 AS n_enlaces
FROM bare""",
    "q_paragraphs": f"""
WITH {_PARAGRAPHS}, {_LONG}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS i, parrafo FROM long_ones""",
    "q_story_articles": f"""
WITH {_BARE},
parts AS (
  SELECT page_id, url, {_H1} AS h1, string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:] AS p FROM bare),
texts AS (
  SELECT page_id, i, CASE WHEN contains(p[i], '</p>') THEN split_part(p[i], '</p>', 1)
                          ELSE array_to_string(p[i:], '<p>') END AS inner_html
  FROM parts, unnest(range(1, len(p) + 1)) AS u(i)),
bodies AS (SELECT page_id, string_agg({_text('inner_html')}, chr(10) ORDER BY i) AS contenido FROM texts GROUP BY 1)
SELECT 'Clarín' AS diario, CAST({_PAGE_DAY} AS VARCHAR) AS fecha, {_text('h1')} AS "titulo noticia",
       coalesce(contenido, '') AS contenido, url AS link
FROM parts LEFT JOIN bodies USING (page_id)""",
    "q_headline_articles": f"""
WITH {_BARE},
texts AS (
  SELECT page_id, url, {_H1} AS h1,
         regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', '', 'g') AS body
  FROM bare)
SELECT CAST({_PAGE_DAY} AS VARCHAR) || ' 14:30:00' AS fecha,
       day({_PAGE_DAY}) || ' de ' || {_MESES}[month({_PAGE_DAY})] || ' ' || year({_PAGE_DAY}) || ' - 14:30' AS fecha_raw,
       trim(regexp_replace({_text('h1')}, '{_SPACE}+', ' ', 'g')) AS titulo, 'No encontrado' AS resumen,
       trim(regexp_replace(replace(replace(body, '&quot;', '"'), '&amp;', '&'), '{_SPACE}+', ' ', 'g')) AS articulo,
       url, 'opinion' AS seccion
FROM texts""",
    "q_sitemap_articles": f"""
WITH {_PARAGRAPHS}, {_LONG},
bodies AS (SELECT page_id, string_agg(parrafo, chr(10) || chr(10) ORDER BY i) AS texto FROM long_ones GROUP BY 1)
SELECT CAST(NULL AS VARCHAR) AS id, split_part(ltrim({_PATH}, '/'), '/', 1) AS seccion,
       CAST({_PAGE_DAY} AS VARCHAR) || 'T22:30:00-03:00' AS fecha_publicacion, {_text(_TITLE)} AS titulo, url,
       'page ' || page_id AS bajada, texto, CAST(200 AS BIGINT) AS status
FROM pages LEFT JOIN bodies USING (page_id)
WHERE starts_with(url, 'https://') AND (contains(lower({_PATH}), '/en/') OR contains(lower({_PATH}), '/es/'))
  AND {_PAGE_DAY} BETWEEN DATE '2025-01-01' AND DATE '2025-04-30'""",
    "q_page_lookup": f"""
SELECT url AS link, CASE WHEN page_id % 2 = 1 THEN CAST({_PAGE_DAY} AS VARCHAR) ELSE '2024-06-01' END AS lastmod, page_id
FROM pages""",
    "q_feed_many": """
WITH entries AS (
  SELECT event_id // 20 AS feed, (event_id // 20) % 4 AS kind, row_number() OVER (PARTITION BY event_id // 20 ORDER BY event_id) - 1 AS entry_pos,
         event_id AS n, 'https://example.com/e/' || event_id AS url, strftime(ts, '%Y-%m-%d') AS dia FROM events)
SELECT feed, entry_pos, CASE kind WHEN 1 THEN 'A ' WHEN 2 THEN 'R ' ELSE 'T & ' END || n AS title,
       CASE WHEN kind = 1 AND n % 3 = 0 THEN 'self' WHEN kind = 0 AND n % 6 = 0 THEN '' ELSE url END AS link,
       CASE WHEN kind = 0 AND n % 4 = 0 THEN 'u ' ELSE '' END || dia AS published
FROM entries WHERE kind < 3""",
    "q_feed_quarantine": "SELECT DISTINCT event_id // 20 AS feed, 'malformed XML' AS error FROM events WHERE (event_id // 20) % 4 = 3",
    "q_sitemap_many": f"""
SELECT page_id // 30 AS sitemap, row_number() OVER (PARTITION BY page_id // 30 ORDER BY page_id) - 1 AS pos, url,
       CASE WHEN page_id % 3 = 0 THEN CAST({_PAGE_DAY} AS VARCHAR) WHEN page_id % 5 > 0 THEN '2024-06-01' END AS lastmod
FROM pages QUALIFY page_id % 8 > 0""",
    "q_linked_varied": f"""
WITH {_VARIED}
SELECT regexp_extract(url, '-nid([0-9]+)', 1) AS id, CASE WHEN there AND doc_id % 5 IN (0, 2) THEN 'Politica' ELSE seccion END AS seccion,
       CASE WHEN there THEN dia || CASE doc_id % 5 WHEN 1 THEN 'T11:30:00+00:00' WHEN 0 THEN 'T10:00:00-03:00' WHEN 2 THEN 'T10:00:00-03:00'
         ELSE 'T09:15:00.25-03:00' END END AS fecha_publicacion,
       CASE WHEN there THEN 'Nota ' || doc_id || CASE WHEN doc_id % 3 = 2 THEN ' - LA NACION Deportes' ELSE '' END END AS titulo, url,
       CASE WHEN there THEN 'bajada ' || doc_id END AS bajada,
       CASE WHEN there THEN 'Un parrafo que pasa de los cuarenta caracteres, numero ' || doc_id END AS texto, 200::BIGINT AS status
FROM varied WHERE read""",
    "q_headline_varied": f"""
WITH {_VARIED}
SELECT url, 'No encontrada' AS fecha_raw, 'Titular ' || doc_id AS titulo, CASE WHEN doc_id % 2 = 0 THEN 'Resumen ' || doc_id ELSE 'No encontrado' END AS resumen,
       'corto ' || doc_id || 'Un parrafo que pasa de los cuarenta caracteres, numero ' || doc_id AS articulo
FROM varied WHERE read AND there AND doc_id % 4 > 0""",
    "q_unreadable_pages": "SELECT doc_id, 'no page' AS error FROM documents WHERE doc_id % 11 = 0",
    "q_varied_lookup": f"""
WITH {_VARIED}, first_page AS (SELECT url, min(doc_id) AS page_doc FROM varied WHERE read GROUP BY url)
SELECT doc_id, page_doc FROM varied JOIN first_page USING (url)""",
    "q_listing_labels": """
WITH articles AS (SELECT doc_id, doc_id // 11 AS pagina, row_number() OVER (PARTITION BY doc_id // 11 ORDER BY doc_id) AS nth FROM documents)
SELECT pagina, nth - 1 AS pos, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 < 2 THEN 'Titular ' || doc_id END AS title,
       'https://www.example.com' || CASE WHEN doc_id % 5 > 0 THEN '/nota/' || doc_id ELSE '/otra' END AS link
FROM articles""",
    "q_page_file_rows": "SELECT filas, count(*) AS archivos FROM (SELECT count(*) AS filas FROM documents GROUP BY doc_id // 11) GROUP BY filas",
    "q_l2_normalize": """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x,
         sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS norm
  FROM embeddings)
SELECT vec_id, i::BIGINT AS i, round(x / norm, 6) AS x FROM parts""",
    "q_daily_vectors": _mean_rows("fecha_dia"),
    "q_day_section_vectors": _mean_rows("fecha_dia, seccion"),
    "q_day_pca": _pca("fecha_dia", "fecha_dia, count_noticias, least(greatest(count_noticias, 10), 120) AS marker_size"),
    "q_section_pca": _pca("fecha_dia, seccion", "fecha_dia, seccion, count_noticias"),
    "q_day_cosine": f"""
WITH {_VECTORS},
parts AS (SELECT fecha_dia, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM vectors),
means AS (SELECT fecha_dia, i, avg(x) AS x FROM parts GROUP BY 1, 2),
days AS (SELECT fecha_dia, list(x ORDER BY i) AS v FROM means GROUP BY 1)
SELECT a.fecha_dia AS fecha_dia_a, b.fecha_dia AS fecha_dia_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
FROM days a, days b""",
    "q_near_articles": f"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS node FROM documents GROUP BY text), {_unit_terms("texts")},
links AS (
  SELECT a.node AS a, b.node AS b FROM unit a JOIN unit b ON a.term = b.term AND a.node < b.node
  GROUP BY ALL HAVING sum(a.w * b.w) >= 0.75),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT node AS a, node AS b FROM unit UNION SELECT r.a, l.b FROM reach r JOIN ends l ON r.b = l.a),
classes AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, class_id IS NULL OR class_id = doc_id AS kept,
       CASE WHEN class_id IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY class_id) END AS members
FROM documents d JOIN texts t ON d.text IS NOT DISTINCT FROM t.text LEFT JOIN classes USING (node)""",
    "q_term_vectors": f"""
WITH {_NEWS}, titles AS (SELECT doc_id AS node, titulo AS text FROM news), {_hashed_terms("titles", 64)},
places AS (SELECT node, unnest(range(64)) AS place FROM (SELECT DISTINCT node FROM vectors WHERE x IS NOT NULL))
SELECT node AS doc_id, place AS i, round(coalesce(x, 0), 6) AS x FROM places LEFT JOIN vectors USING (node, place)""",
    "q_similar_articles": f"""
WITH articles AS (SELECT doc_id AS node, text FROM documents), {_hashed_terms("articles", 256)},
cosines AS (
  SELECT q.node AS query_id, v.node AS doc_id, round(sum(q.x * v.x), 9) AS cosine FROM vectors q JOIN vectors v ON q.place = v.place AND q.node <> v.node
  WHERE q.node % 50 = 0 GROUP BY ALL HAVING cosine >= 0.65)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank, doc_id, round(cosine, 6) AS cosine
FROM cosines QUALIFY rank <= 10""",
    "q_similar_days": f"""
WITH {_VECTORS},
parts AS (SELECT fecha_dia, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM vectors),
means AS (SELECT fecha_dia, i, avg(x) AS x FROM parts GROUP BY 1, 2),
days AS (SELECT fecha_dia, list(x ORDER BY i) AS v FROM means GROUP BY 1),
cosines AS (
  SELECT a.fecha_dia, b.fecha_dia AS other, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM days a JOIN days b ON a.fecha_dia <> b.fecha_dia)
SELECT fecha_dia, row_number() OVER (PARTITION BY fecha_dia ORDER BY cosine DESC, other) AS rank, other, round(cosine, 6) AS cosine
FROM cosines QUALIFY rank <= 5""",
    "q_language": f"WITH {_DETECTED} SELECT doc_id, idioma FROM detected",
    "q_language_days": f"""
WITH {_DETECTED}
SELECT CAST(fecha AS VARCHAR) AS fecha, idioma, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fecha), 9) AS share
FROM detected GROUP BY fecha, idioma""",
    "q_next_traded": f"""
WITH {_TARGET}
SELECT CAST(fecha AS VARCHAR) AS fecha, n_noticias, cierre_previo, cierre_siguiente, round(cierre_siguiente / cierre_previo - 1, 9) AS retorno
FROM target""",
    "q_next_day_ridge": f"""
WITH {_TARGET},
usable AS (SELECT 1 AS g, n_noticias::DOUBLE AS x, largo AS z, cierre_siguiente AS y FROM target WHERE cierre_siguiente IS NOT NULL AND largo IS NOT NULL),
{_ridge("usable", "g")}
SELECT n, unnest(['n_noticias', 'largo', 'intercept']) AS term, round(unnest([bx, bz, b0]), 6) AS coefficient FROM fitted""",
    "q_next_day_folds": f"""
WITH {_TARGET},
placed AS (SELECT *, ((row_number() OVER (ORDER BY fecha) - 1) * 4) // (count(*) OVER ()) AS stretch FROM target),
folds AS (
  SELECT fold, stretch < fold AS learnt, n_noticias::DOUBLE AS x, largo AS z, cierre_siguiente AS y
  FROM placed, (SELECT unnest([1, 2, 3]) AS fold) WHERE stretch <= fold AND cierre_siguiente IS NOT NULL AND largo IS NOT NULL),
known AS (SELECT fold, x, z, y FROM folds WHERE learnt),
{_ridge("known", "fold")}
SELECT fold::BIGINT AS fold, any_value(n) AS n_aprende, count(*) AS n_prueba, round(sqrt(avg((y - b0 - bx * x - bz * z) ** 2)), 6) AS error,
       round(sqrt(avg((y - my) ** 2)), 6) AS error_base
FROM folds JOIN fitted USING (fold) WHERE NOT learnt GROUP BY fold""",
    "q_axis_correlations": f"""
WITH axes AS ({_pca("fecha_dia", "fecha_dia, count_noticias")}),
shares AS (SELECT CAST(label AS BIGINT) AS fecha_dia, avg(CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS politica FROM embeddings GROUP BY 1),
days AS (SELECT * FROM axes JOIN shares USING (fecha_dia)),
pairs AS (
  SELECT lag, x.count_noticias::DOUBLE AS count_noticias, x.politica, y.pc1, y.pc2
  FROM days x CROSS JOIN (SELECT unnest([0, 1, 2]) AS lag) JOIN days y ON y.fecha_dia = x.fecha_dia + lag),
found AS (
  SELECT 'count_noticias' AS a, 'pc1' AS b, lag, count_noticias AS u, pc1 AS v FROM pairs UNION ALL
  SELECT 'count_noticias', 'pc2', lag, count_noticias, pc2 FROM pairs UNION ALL
  SELECT 'politica', 'pc1', lag, politica, pc1 FROM pairs UNION ALL SELECT 'politica', 'pc2', lag, politica, pc2 FROM pairs)
SELECT a, b, lag::BIGINT AS lag, count(*) AS n, CASE WHEN max(u) > min(u) AND max(v) > min(v) THEN round(corr(u, v), 6) END AS corr
FROM found GROUP BY a, b, lag""",
    "q_question_prompts": f"""
WITH {_NEWS}, filled AS (
  SELECT doc_id, coalesce(diario, 'unknown') AS diario, coalesce(CAST(fecha AS VARCHAR), 'unknown') AS fecha,
         coalesce(seccion, 'unknown') AS seccion, coalesce(titulo, 'unknown') AS titulo FROM news)
SELECT doc_id, unnest(['tendencia', 'sube', 'mineria', 'exterior']) AS id, unnest([
  diario || ' ' || fecha || ': ' || titulo || ' [alcista | bajista]', fecha || ': ' || titulo || ' [0.0 .. 100.0]',
  titulo || ' [+/- 0.0 .. 3.0]', seccion || ' [si | no]']) AS prompt FROM filled""",
    "q_question_answers": f"WITH {_ASKED} SELECT doc_id, question, kind, value, label, violation FROM answers",
    "q_question_days": f"""
WITH {_ASKED}
SELECT CAST(fecha AS VARCHAR) AS fecha, question, count(*) AS n, count(*) FILTER (violation IS NULL) AS valid, round(avg(value), 9) AS avg_value,
       count(*) FILTER (label IN ('alcista', 'positivo')) AS up
FROM answers GROUP BY fecha, question""",
    "q_topics": f"""
WITH {_topics()},
long AS ({_long("col_4", "col", "{t}")}),
shares AS (SELECT topic, col AS term, round(w / sum(w) OVER (PARTITION BY topic), 9) AS weight FROM long)
SELECT topic::BIGINT AS topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank, term, round(weight, 7) AS weight
FROM shares QUALIFY rank <= 10""",
    "q_topic_days": f"""
WITH {_topics()},
long AS ({_long("row_4", '"row"', "{t} * (SELECT sum({t}) FROM col_4)")}),
fit AS (SELECT c.x, coalesce(r.t0 * k.t0 + r.t1 * k.t1 + r.t2 * k.t2, 0) AS y FROM row_4 r CROSS JOIN col_4 k LEFT JOIN cells c ON c."row" = r."row" AND c.col = k.col)
SELECT "row" AS fecha, topic::BIGINT AS topic, round(w / sum(w) OVER (PARTITION BY "row"), 7) AS share,
       (SELECT round(sum((coalesce(x, 0) - y) ** 2), 3) FROM fit) AS error
FROM long""",
    "q_prompt": f"WITH {_NEWS} SELECT doc_id, {_user_prompt()} AS user_prompt FROM news",
    "q_score": f"""
WITH {_NEWS}, prompts AS (SELECT doc_id, {_user_prompt()} AS p FROM news)
SELECT doc_id, length(p) AS largo, contains(lower(p), ' {STUB_WORDS['inflacion']} ') AS inflacion,
       contains(lower(p), ' {STUB_WORDS['pbi']} ') AS pbi
FROM prompts""",
    "q_score_missing": f"""
WITH {_NEWS}, prompts AS (SELECT doc_id, url, {_user_prompt()} AS p FROM news)
SELECT doc_id, url, length(p) AS largo, contains(lower(p), ' {STUB_WORDS['reservas']} ') AS reservas, true AS answered FROM prompts""",
    "q_parse_features": f"""
WITH {_NEWS}, {_ANSWERED}
SELECT doc_id, quality IS NULL AS corrupt, CASE WHEN quality IS NOT NULL THEN 0.25::DOUBLE END AS confianza,
       CASE WHEN good THEN 'fiscal' WHEN quality IS NOT NULL THEN 'raro' END AS tipo_evento,
       CASE WHEN quality IS NOT NULL AND toxic <> 1 THEN length(contenido) END AS horizonte_dias, good AS menciona_fmi,
       CASE WHEN good THEN -0.5::DOUBLE WHEN quality IS NOT NULL THEN 7::DOUBLE END AS direccion
FROM answered""",
    "q_validate_features": f"""
WITH {_NEWS}, {_ANSWERED}
SELECT doc_id, CASE WHEN good THEN 'fiscal' ELSE 'desconocido' END AS tipo_evento,
       CASE WHEN good THEN 'bcra' ELSE 'desconocido' END AS actor, 'unknown' AS nombre, CAST(0 AS BIGINT) AS n_tickers,
       CASE WHEN quality IS NULL THEN '{_all_missing()}' WHEN good THEN '{_violations(True)}' ELSE '{_violations(False)}' END AS violations
FROM answered""",
    "q_llm_backfill": f"""
WITH {_NEWS}, {_ANSWERED}
SELECT doc_id, diario, CAST(fecha AS VARCHAR) AS fecha, CASE WHEN quality IS NULL THEN seccion ELSE 'otra' END AS seccion, url
FROM answered""",
    "q_backfill_join": f"""
WITH {_NEWS}, {_ANSWERED}
SELECT doc_id, diario, CAST(fecha AS VARCHAR) AS fecha,
       CASE WHEN quality IS NULL THEN seccion ELSE 'otra' END AS seccion
FROM answered""",
    "q_flatten": f"WITH {_NEWS}, {_ANSWERED} SELECT {_flat_columns()} FROM answered",
    "q_daily_features": f"""
WITH {_NEWS}, {_ANSWERED}, flat AS (SELECT {_flat_columns()} FROM answered)
SELECT fecha, diario, count(*) AS n_articles,
       round(avg(mercado__merval__direccion), 9) AS avg_mercado__merval__direccion,
       round(sum(mercado__merval__direccion * calidad_fuente__calidad_fuente_score)
             / sum(CASE WHEN mercado__merval__direccion IS NOT NULL THEN calidad_fuente__calidad_fuente_score END), 9)
         AS wavg_mercado__merval__direccion,
       round(avg(evento__horizonte_dias), 9) AS avg_evento__horizonte_dias,
       round(sum(evento__horizonte_dias * calidad_fuente__calidad_fuente_score)
             / sum(CASE WHEN evento__horizonte_dias IS NOT NULL THEN calidad_fuente__calidad_fuente_score END), 9)
         AS wavg_evento__horizonte_dias,
       round(avg(CAST(CAST(tematicas__menciona_fmi AS INT) AS DOUBLE)), 9) AS share_tematicas__menciona_fmi,
       count(*) FILTER (evento__tipo_evento = 'fiscal') AS n_evento__tipo_evento__fiscal,
       count(*) FILTER (evento__tipo_evento = 'desconocido') AS n_evento__tipo_evento__desconocido,
       count(*) FILTER (evento__shock = 'mixto') AS n_evento__shock__mixto
FROM flat GROUP BY fecha, diario""",
    "q_sections": """
SELECT CASE WHEN lang IN ('en', 'de') THEN 'politica' WHEN lang IN ('fr', 'es') THEN 'economia' END AS seccion, count(*) AS n
FROM documents GROUP BY 1""",
    "q_top_per_day": f"""
WITH {_NEWS}
SELECT doc_id, diario, CAST(fecha AS VARCHAR) AS fecha,
       row_number() OVER (PARTITION BY diario, fecha ORDER BY length(contenido) DESC, doc_id) AS rank
FROM news QUALIFY rank <= 2""",
    "q_top_rows": """
SELECT l_returnflag, l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank
FROM lineitem QUALIFY rank <= 1500""",
    "q_score_failures": """
SELECT doc_id, lang <> 'de' AS answered, CASE WHEN lang = 'de' THEN 'ValueError: no answer' END AS error FROM documents""",
    "q_feature_flow": f"""
WITH {_NEWS}, prompts AS (SELECT *, {_user_prompt()} AS p FROM news)
SELECT doc_id, diario, CAST(fecha AS VARCHAR) AS fecha, 'otra' AS seccion, url,
       contains(lower(p), ' {STUB_WORDS['deuda']} ') AS deuda, CAST(7 AS BIGINT) AS n_violations
FROM prompts""",
    "q_exploration_export": f"""
WITH {_NEWS} SELECT CAST(fecha + 1 AS VARCHAR) AS fecha_dia, count(*) AS count_noticias FROM news GROUP BY 1""",
    "q_exploration_vectors": f"""
WITH {_NEWS} SELECT CAST(fecha + 1 AS VARCHAR) AS fecha_dia, count(*) AS count_noticias, CAST(256 AS BIGINT) AS n FROM news GROUP BY 1""",
    "q_embed_encoder": f"""
WITH {_NEWS}, has AS (
  SELECT doc_id, [true] || [contains(titulo, l) FOR l IN {list(STUB_LETTERS)}] AS v FROM news
), parts AS (
  SELECT doc_id, v, sqrt(len([y FOR y IN v IF y])) AS norm, unnest(range(len(v))) AS i FROM has
)
SELECT doc_id, i, round(CASE WHEN v[i + 1] THEN CAST(1 / norm AS FLOAT)::DOUBLE ELSE 0 END, 6) AS x FROM parts""",
    "q_snapshot": f"WITH {_NEWS} SELECT doc_id, diario, pagina FROM news",
    "q_empty_tables": "SELECT doc_id, source AS diario, CAST(NULL AS VARCHAR) AS nota FROM documents",
    "q_list_text": "SELECT doc_id, source || '|l' || chr(39) || lang || '|a' || chr(160) || 'b' AS lista FROM documents",
    "q_csv_roundtrip": f"""
WITH {_NEWS} SELECT diario, CAST(fecha AS VARCHAR) AS fecha, titulo, contenido, url AS link FROM news""",
    "q_page_files": "SELECT doc_id // 11 AS pagina, count(*) AS n FROM documents GROUP BY 1",
    "q_stream_dedup": """
SELECT user_id || '/' || event_type AS url, event_id, CAST(ts AS VARCHAR) AS ts FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
    "q_stream_window_dedup": "SELECT DISTINCT user_id || '/' || event_type AS url FROM events",
    "q_stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS fecha_dia, count(*) AS count_noticias FROM events GROUP BY 1",
    "q_stream_top": _RSS_TOP,
}
