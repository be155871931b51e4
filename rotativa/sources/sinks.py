"""Table writers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotativa.sources.readers import format_of


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, since CSV holds scalars only."""
    return df.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV, chosen by the suffix. An empty table still leaves its schema or header."""
    if format_of(path) == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        (
            nested_as_json(df)
            .write.mode(mode)
            .options(header="true", escape='"', encoding="UTF-8", emptyValue='""')
            .csv(path)
        )


def write_by_page(
    df: DataFrame, path: str, page_col: str = "pagina", pages_per_dir: int = 1000, mode: str = "overwrite"
) -> None:
    """Listing pages kept apart on disk: a directory per run of pages, rows sorted by page inside.

    A filter on ``page_group`` and the page column opens only the row groups of that page. With
    ``pages_per_dir=1`` each page has its own directory, which suits a few thousand pages. The
    rebalance hint gathers a directory into few files; AQE splits one too large for a task.
    """
    grouped = df.withColumn("page_group", F.floor(F.col(page_col) / pages_per_dir))
    (
        grouped.hint("rebalance", "page_group")
        .sortWithinPartitions("page_group", page_col)
        .write.mode(mode)
        .partitionBy("page_group")
        .parquet(path)
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def snapshot(spark: SparkSession, path: str, backup_root: str, at: datetime | None = None) -> str:
    """Copy a table to ``<backup_root>/snapshot=<timestamp>`` and return that path."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    target = f"{backup_root.rstrip('/')}/snapshot={stamp}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(target)
    return target
