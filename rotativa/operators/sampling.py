"""Fixed-size samples and first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of ``key``: the same for any partitioning of the table."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.orderBy(draw, key).limit(n)


def first_n(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
