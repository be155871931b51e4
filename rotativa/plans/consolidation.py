"""Four papers to one news table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.constants import BORDER_DAYS, WINDOW_END, WINDOW_START
from rotativa.functions.dates import parse_day, written_day
from rotativa.operators.filters import date_window, not_in
from rotativa.operators.schema_ops import conform
from rotativa.schemas import NEWS
from rotativa.sources.readers import read_page_files

_STORY_NAMES = {"titulo noticia": "titulo", "link": "url"}


def fold_page_files(spark: SparkSession, glob: str, errors: str = "raise") -> DataFrame:
    """Per-page CSV files of one paper as one table without the border days, ``fecha`` as a date."""
    rows = not_in(read_page_files(spark, glob).drop("archivo"), "fecha", BORDER_DAYS)
    return rows.withColumn("fecha", parse_day("fecha", errors))


def from_headline(df: DataFrame) -> DataFrame:
    return (
        df.withColumnsRenamed({"articulo": "contenido"})
        .withColumns({"diario": F.lit("Ámbito Financiero"), "fecha": F.col("fecha").try_cast("timestamp_ntz").cast("date")})
        .drop("resumen", "fecha_raw")
    )


def from_story(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(_STORY_NAMES).withColumns(
        {"seccion": F.lit("economia"), "fecha": F.col("fecha").try_cast("date")}
    )


def from_linked(df: DataFrame) -> DataFrame:
    return (
        df.withColumnsRenamed({"fecha_publicacion": "fecha", "texto": "contenido"})
        .withColumns({"diario": F.lit("La Nación"), "fecha": written_day("fecha")})
        .drop("id", "status", "bajada")
    )


def consolidate(tables: list[DataFrame], start: str = WINDOW_START, end: str = WINDOW_END) -> DataFrame:
    """Rows of all tables inside the window, in the canonical columns; repeated articles stay."""
    conformed = [conform(date_window(df, "fecha", start, end), NEWS) for df in tables]
    return reduce(DataFrame.unionByName, conformed)
