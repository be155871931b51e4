"""Schema operators: rename, conform, report, assert, profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "source string, column string, kind string"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order, cast, missing ones null."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def schema_report(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """One row per column a table lacks (``missing``) or has beyond ``expected`` (``extra``)."""
    rows = []
    for source, df in tables.items():
        rows += [(source, c, "missing") for c in expected if c not in df.columns]
        rows += [(source, c, "extra") for c in df.columns if c not in expected]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, REPORT)


def schema_drift_rows(tables: dict[str, DataFrame], expected: list[str]) -> DataFrame:
    """The schema report with the number of rows each finding touches."""
    sizes = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(s).alias("source"), "n_rows") for s, df in tables.items()],
    )
    return schema_report(tables, expected).join(sizes, "source")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """The table itself; raises before any job when a column is missing."""
    for name in required:
        if name not in df.columns:
            raise ValueError(f"required column is missing: {name}")
    return df


def select_present(df: DataFrame, columns: list[str], optional: list[str]) -> DataFrame:
    """``columns`` plus those of ``optional`` that exist."""
    return df.select(*columns, *[c for c in optional if c in df.columns])


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count and number of rows, from one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns]
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"`{c}`").alias("non_null"))
            for c in df.columns
        ]
    )
    return counts.select(F.explode(entries).alias("e"), F.col("_rows").alias("n_rows")).select("e.*", "n_rows")
