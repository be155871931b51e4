"""Counts, lengths, histogram and base text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.functions.text import char_count, or_default, strip_space, word_count


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), col)
    )


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key, ordered by key; null keys are not counted."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(*keys)


def distinct_by(df: DataFrame, key: str, what: str, name: str = "n_distinct") -> DataFrame:
    """Distinct non-null values per key, ordered by key."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.countDistinct(what).alias(name)).orderBy(key)


def with_lengths(df: DataFrame, text: str = "texto_base") -> DataFrame:
    return df.withColumns({"len_chars": char_count(text), "len_words": word_count(text)})


def histogram(df: DataFrame, value: Column | str, bins: int = 40) -> DataFrame:
    """Counts in ``bins`` equal bins over ``[min, max]``, the last one closed; empty bins included.

    When all values are equal the range is one unit wide around them.
    """
    values = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).dropna()
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(
        F.struct(
            F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    )
    lo, hi = span.scalar()["lo"], span.scalar()["hi"]
    bin_of = F.least(F.floor((F.col("x") - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.join(counts, "bin", "left")
        .select(
            "bin",
            (lo + (hi - lo) * F.col("bin") / bins).alias("left_edge"),
            (lo + (hi - lo) * (F.col("bin") + 1) / bins).alias("right_edge"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def with_base_text(df: DataFrame, per_row: bool = False, out: str = "texto_base") -> DataFrame:
    """Text to analyse: ``texto``, or title and summary when the table has no ``texto`` at all.

    With ``per_row`` the choice is made for each article instead.
    """
    title = or_default("titulo") if "titulo" in df.columns else F.lit("")
    short = strip_space(F.concat(title, F.lit(" "), or_default("bajada"))) if "bajada" in df.columns else title
    if "texto" not in df.columns:
        return df.withColumn(out, short)
    if per_row:
        return df.withColumn(out, F.coalesce("texto", short))
    # One matching row answers the question, so the check stops at the first one.
    any_text = df.filter(F.col("texto").isNotNull()).select(F.lit(True).alias("found")).limit(1).scalar()
    return df.withColumn(out, F.when(F.coalesce(any_text, F.lit(False)), or_default("texto")).otherwise(short))
