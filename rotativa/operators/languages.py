"""The language of an article, from the ranks of its letter triples, and shares of languages per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.functions.text import or_default
from rotativa.operators.rank import top_n

PROFILE = 300


def letter_triples(text: str) -> Column:
    """All runs of three letters of a text's words, which have a mark before and behind."""
    marked = F.concat(F.lit("_"), F.regexp_replace(F.lower(or_default(text)), r"[^\p{L}]+", "_"), F.lit("_"))
    # One pass that looks at every place; marks are neighbours of one word only.
    return F.regexp_extract_all(marked, F.lit(r"(?=([^_]{3}|_[^_]{2}|[^_]{2}_|_[^_]_))"), F.lit(1))


def profiles(df: DataFrame, language: str, text: str, size: int = PROFILE) -> DataFrame:
    """(language, triple, gain): the ``size`` most frequent triples of each language, ``size`` for the first, 1 for the last.

    Equal counts are put in the order of the triples. Rows without a language don't count.
    """
    triples = df.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(letter_triples(text)).alias("triple"))
    counted = triples.groupBy("language", "triple").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_n(counted, ["language"], [F.desc("n"), F.col("triple")], size)
    return ranked.select("language", "triple", (F.lit(size + 1) - F.col("rank")).cast("long").alias("gain"))


def detect_language(df: DataFrame, known: DataFrame, key: str, text: str, out: str = "idioma") -> DataFrame:
    """``df`` with the language whose profile its triples rank highest in; null where no triple is known.

    A triple counts with its gain each time it occurs; equal sums go to the first language in order.
    ``key`` names each row once. ``known`` has at most PROFILE rows per language and is broadcast; counts
    per row are made before the shuffle.
    """
    found = df.select(key, F.explode(letter_triples(text)).alias("triple")).join(F.broadcast(known), "triple")
    sums = found.groupBy(key, "language").agg(F.sum("gain").alias("gain"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("gain")).alias("low"), F.col("language"))).alias("best"))
    return df.join(best.select(key, F.col("best.language").alias(out)), key, "left")


def language_shares(df: DataFrame, day: str, language: str = "idioma") -> DataFrame:
    """(day, language, n, share): articles of each language and their share of the day's; unknown ones are a language."""
    counted = df.groupBy(day, language).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(day))
    return counted.withColumn("share", F.col("n") / whole)
