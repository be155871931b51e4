"""Ranking and top-N per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.constants import LOCAL_ZONE, RSS_COLUMNS
from rotativa.functions.dates import feed_utc, local_iso, local_wall
from rotativa.operators.dedup import first_title


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group with their rank; ``order`` must be total.

    Spark cuts each map task to ``n`` rows per group up to its group-limit threshold. Beyond it
    groups are first cut within what each input partition has of them, so the parts of a group grow
    in number with the table and no task sorts a whole large group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salted = df.withColumn("_salt", F.spark_partition_id())
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def rss_ranked(
    entries: DataFrame, n: int = 10, ingested_at: str = "ingested_at", seen_order: tuple[str, ...] = ("feed_pos", "entry_pos")
) -> DataFrame:
    """Top ``n`` entries per source, newest first, with ``published_at`` (UTC) and ``rank_in_source``.

    Copies of a title are removed first and the one read first stays, even if a later copy is
    newer. Entries without a readable date count as published when the feed was read.
    """
    titled = first_title(entries, order=list(seen_order))
    dated = titled.withColumn("published_at", feed_utc("published", ingested_at))
    order = [F.col("published_at").desc(), *map(F.col, seen_order)]
    return top_n(dated, ["source"], order, n, "rank_in_source")


def rss_columns(ranked: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """The published columns of ranked entries, dates on the wall clock of ``zone``."""
    local = local_wall("published_at", zone)
    return ranked.withColumns(
        {"date": F.substring(local.cast("string"), 1, 10), "published_at_local": local_iso("published_at", zone)}
    ).select(*RSS_COLUMNS)


def rss_top(entries: DataFrame, n: int = 10) -> DataFrame:
    return rss_columns(rss_ranked(entries, n))
