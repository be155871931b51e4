"""Row filters."""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.constants import BORDER_DAYS, WINDOW_END, WINDOW_START
from rotativa.functions.dates import parse_day
from rotativa.operators.joins import SMALL_KEY_ROWS, copy_rows, hot_keys, split_rows


def date_window(df: DataFrame, col: str = "fecha", start: str = WINDOW_START, end: str = WINDOW_END) -> DataFrame:
    """Rows whose day lies in ``[start, end]``; null days fall out."""
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def not_in(df: DataFrame, col: str = "fecha", values: list = BORDER_DAYS) -> DataFrame:
    """Rows whose value is not listed; nulls stay."""
    return df.filter(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def keep_sources(df: DataFrame, wanted: list[str], known: list[str], col: str = "source") -> DataFrame:
    """Rows of the wanted sources; unknown names are ignored, but one must be known."""
    chosen = [s for s in known if s in set(wanted)] if wanted else list(known)
    if not chosen:
        raise ValueError(f"none of these sources is known: {wanted}")
    return df.filter(F.col(col).isin(*chosen))


def good_and_bad_dates(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """The table split by whether ``col`` parses as a day; the bad part is the quarantine."""
    day = parse_day(col)
    return df.filter(day.isNotNull()).withColumn(col, day), df.filter(day.isNull())


def month_from_text(c: Column) -> Column:
    """First day of the ``YYYY-MM`` found in a text, null when there is none."""
    year = F.regexp_extract(c, r"(\d{4})-(\d{2})", 1)
    month = F.regexp_extract(c, r"(\d{4})-(\d{2})", 2)
    return F.concat_ws("-", F.nullif(year, F.lit("")), month, F.lit("01")).try_cast("date")


def months_overlapping(df: DataFrame, month: Column, start: date | str, end: date | str) -> DataFrame:
    """Rows whose calendar month shares a day with ``[start, end]``.

    The column itself is compared, with the first day of one month and the last of another, so the
    filter reaches the scan.
    """
    first, last = date.fromisoformat(str(start)[:10]), date.fromisoformat(str(end)[:10])
    if first > last:
        return df.filter(F.lit(False))
    last = last.replace(day=monthrange(last.year, last.month)[1])
    return df.filter((month >= F.lit(first.replace(day=1))) & (month <= F.lit(last)))


def month_window_join(df: DataFrame, month_col: str, windows: DataFrame, small: int = SMALL_KEY_ROWS) -> DataFrame:
    """Pair rows with every window (``start``, ``end`` and other columns) their month overlaps.

    Each window is expanded to its months, so this is an equi-join and not a range comparison of
    all pairs. A month listed twice in one window is impossible, so nothing is repeated. There are few
    months, so those with many rows are split and the windows copied to their parts.
    """
    months = windows.withColumn(
        month_col, F.explode(F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("INTERVAL 1 MONTH")))
    )
    hot = hot_keys(df, [month_col], small)
    left, right = split_rows(df, hot, [month_col]), copy_rows(months, hot, [month_col])
    return left.join(right, [month_col, "_part"]).drop("_part")
