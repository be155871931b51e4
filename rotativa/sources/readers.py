"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from rotativa.schemas import RAW_ARTICLE

# Quoted fields may hold line breaks and doubled quotes.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def format_of(path: str) -> str:
    """``parquet`` for a ``.parquet`` path in any letter case, else ``csv``."""
    return "parquet" if path.lower().endswith(".parquet") else "csv"


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(paths)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV, chosen by the suffix of the path. CSV needs a schema."""
    if format_of(path) == "csv":
        if schema is None:
            raise ValueError("a CSV table needs an explicit schema")
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_page_files(spark: SparkSession, glob: str, schema: T.StructType = RAW_ARTICLE) -> DataFrame:
    """All per-page CSV files of a folder as one table, with the file each row came from."""
    return read_csv(spark, glob, schema).withColumn("archivo", F.col("_metadata.file_name"))


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``; an empty one with ``schema`` is written first if missing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)
