"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_ARTICLE = _strings("diario", "fecha", "titulo noticia", "contenido", "link")

AMBITO = _strings("fecha", "titulo", "resumen", "articulo", "url", "seccion")

SITEMAP_ARTICLE = T.StructType(
    _strings("id", "seccion", "fecha_publicacion", "titulo", "url", "bajada", "texto").fields
    + [T.StructField("status", T.IntegerType())]
)

RSS_TOP = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("published_at_local", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("rank_in_source", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
    ]
)

NEWS = T.StructType(
    [
        T.StructField("diario", T.StringType()),
        T.StructField("fecha", T.DateType()),
        T.StructField("titulo", T.StringType()),
        T.StructField("contenido", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("seccion", T.StringType()),
    ]
)

PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)

_IMPACT = T.StructType(
    [T.StructField("direccion", T.DoubleType()), T.StructField("magnitud", T.DoubleType())]
)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


FEATURES = T.StructType(
    [
        T.StructField("diario", T.StringType()),
        T.StructField("fecha", T.StringType()),
        T.StructField("seccion", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField(
            "entidades",
            T.StructType(
                [
                    T.StructField("tipo_actor_principal", T.StringType()),
                    T.StructField("nombre_actor_principal", T.StringType()),
                    T.StructField("empresas_mencionadas", T.ArrayType(T.StringType())),
                    T.StructField("tickers_mencionados", T.ArrayType(T.StringType())),
                    T.StructField("sectores_mencionados", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "evento",
            T.StructType(
                [
                    T.StructField("tipo_evento", T.StringType()),
                    T.StructField("shock", T.StringType()),
                    T.StructField("caracter", T.StringType()),
                    T.StructField("horizonte_dias", T.IntegerType()),
                ]
            ),
        ),
        T.StructField(
            "mercado",
            T.StructType(
                [
                    T.StructField(market, _IMPACT)
                    for market in ("merval", "fx_ars", "tasa_bcra", "bonos_soberanos")
                ]
            ),
        ),
        T.StructField(
            "optimismos",
            _doubles(
                "positividad_general",
                "apoyo_gobernanza",
                "optimismo_macro_corto",
                "optimismo_macro_largo",
                "optimismo_fin_corto",
                "optimismo_fin_largo",
            ),
        ),
        T.StructField(
            "tematicas",
            T.StructType(
                [
                    T.StructField(f"menciona_{topic}", T.BooleanType())
                    for topic in (
                        "inflacion",
                        "pbi",
                        "reservas",
                        "embi",
                        "deuda",
                        "fmi",
                        "salarios_paritarias",
                    )
                ]
            ),
        ),
        T.StructField(
            "calidad_fuente",
            T.StructType(
                [
                    T.StructField("categoria", T.StringType()),
                    T.StructField("calidad_fuente_score", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("confianza", T.DoubleType()),
        T.StructField(
            "evidencia",
            T.StructType(
                [
                    T.StructField("citas_evidencia", T.ArrayType(T.StringType())),
                    T.StructField("notas", T.StringType()),
                ]
            ),
        ),
    ]
)
