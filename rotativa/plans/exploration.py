"""Article table to daily counts, vectors and projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.constants import EDA_REQUIRED
from rotativa.functions.dates import utc_day
from rotativa.functions.vectors import clip
from rotativa.operators.aggregates import with_base_text, with_lengths
from rotativa.operators.schema_ops import require_columns
from rotativa.operators.vectors import Encoder, embed, embed_hashed, mean_vectors, pca
from rotativa.sources.sinks import write_table


def prepare(articles: DataFrame, per_row_text: bool = False) -> DataFrame:
    """Check the columns, choose the text, derive ``fecha_dia`` and the lengths; undated rows drop out."""
    checked = with_base_text(require_columns(articles, EDA_REQUIRED), per_row_text)
    dated = checked.withColumn("fecha_dia", utc_day("fecha_publicacion")).dropna(subset=["fecha_dia"])
    return with_lengths(dated)


def news_embeddings(prepared: DataFrame, load_encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """Per article: id, fecha_dia, seccion, url, titulo, embedding. Without an encoder, hashed TF-IDF."""
    if load_encoder is None:
        vectors = embed_hashed(prepared, "texto_base")
    else:
        vectors = embed(prepared, "texto_base", load_encoder)
    return vectors.select(
        "id", F.col("fecha_dia").cast("string").alias("fecha_dia"), "seccion", "url", "titulo", "embedding"
    )


def daily_embeddings(embeddings: DataFrame) -> DataFrame:
    """fecha_dia, count_noticias, embedding."""
    return mean_vectors(embeddings, ["fecha_dia"])


def export(prepared: DataFrame, folder: str, load_encoder: Callable[[], Encoder] | None = None) -> dict[str, str]:
    """Write the article vectors, the daily vectors and the daily counts; returns their paths.

    Each table is made from the stored one before it, so articles are encoded once.
    """
    paths = {
        "news_embeddings": f"{folder}/news_embeddings.parquet",
        "daily_news_embeddings": f"{folder}/daily_news_embeddings.parquet",
        "daily_news_counts": f"{folder}/daily_news_counts.csv",
    }
    spark = prepared.sparkSession
    write_table(news_embeddings(prepared, load_encoder), paths["news_embeddings"])
    days = daily_embeddings(spark.read.parquet(paths["news_embeddings"]))
    write_table(days.withColumn("embedding", F.col("embedding").cast("array<float>")), paths["daily_news_embeddings"])
    stored = spark.read.parquet(paths["daily_news_embeddings"])
    write_table(stored.select("fecha_dia", "count_noticias").orderBy("fecha_dia"), paths["daily_news_counts"])
    return paths


def daily_map(days: DataFrame) -> DataFrame:
    """Position of each day on the first two principal components, and the size of its marker."""
    return pca(days).select(
        "fecha_dia", "count_noticias", "pc1", "pc2", clip("count_noticias", 10, 120).alias("marker_size")
    )


def section_map(embeddings: DataFrame) -> DataFrame:
    """Position of each (day, section) mean vector on the first two principal components."""
    return pca(mean_vectors(embeddings, ["fecha_dia", "seccion"])).drop("embedding")
