"""First-seen de-duplication and unseen-key selection.

``order`` must decide between any two rows, since a table has no row order of its own. The filter
``row_number() = 1`` lets Spark keep one row per key in each map task before the shuffle, so a key
with very many copies does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def first_title(
    df: DataFrame, source: str = "source", title: str = "title", order: list[Column | str] = ("feed_pos", "entry_pos")
) -> DataFrame:
    """First row of each title per source, ignoring case; empty titles are dropped."""
    titled = df.filter(F.trim(title) != "")
    return first_seen(titled, [F.col(source), F.lower(F.trim(title))], list(order))


def first_url(df: DataFrame, order: list[Column | str], url: str = "url") -> DataFrame:
    return first_seen(df, [url], order)


def seen_keys(stored: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys of a stored table; only the key column is read."""
    return stored.select(key).distinct()


def unseen(incoming: DataFrame, stored: DataFrame, order: list[Column | str], key: str = "url") -> DataFrame:
    """First copy of each incoming key that is not stored yet; rows without a key are dropped.

    Both sides are reduced to one row per key before they meet.
    """
    keyed = incoming.filter(F.col(key).isNotNull())
    return first_seen(keyed, [key], order).join(seen_keys(stored, key), key, "left_anti")
