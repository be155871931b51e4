"""Progress and cut-off over listing pages read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, value: str, out: str, bucket: int = 1000, levels: int = 3) -> DataFrame:
    """Running sum of ``value`` by an integer ``order`` column; null values count as 0, rows of equal order as one step.

    A prefix scan over a tree: sums per ``bucket`` consecutive orders, sums of ``bucket`` such sums, and so
    on for ``levels`` levels. Each level gives its buckets their starting values, and rows are summed
    inside their bucket, so one task only meets what covers ``bucket ** levels`` orders a row.
    """
    inside = Window.partitionBy("_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    sums = bucketed.groupBy("_bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    if levels > 1:
        upto = running_total(sums.withColumnRenamed("_bucket", "_order"), "_order", "_sum", "_upto", bucket, levels - 1).withColumnRenamed("_order", "_bucket")
    else:
        upto = sums.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    starts = upto.select("_bucket", (F.col("_upto") - F.col("_sum")).alias("_start"))
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return bucketed.join(starts, "_bucket").withColumn(out, total).drop("_bucket", "_start")


def page_summary(articles: DataFrame, page: str = "pagina", date: str = "fecha", order: str = "pos") -> DataFrame:
    """Per page: number of articles and the date of the first one."""
    return articles.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_nuevas"), F.min_by(date, order).alias("primera_fecha")
    )


def page_progress(
    new_articles: DataFrame, already_stored: int | Column = 0, page: str = "pagina", date: str = "fecha", order: str = "pos"
) -> DataFrame:
    """Page summary with the number of distinct URLs known after each page."""
    start = F.lit(already_stored) if isinstance(already_stored, int) else already_stored
    summary = page_summary(new_articles, page, date, order)
    return running_total(summary, page, "n_nuevas", "total_urls").withColumn("total_urls", F.col("total_urls") + start)


def until_old_page(
    articles: DataFrame, oldest: str, page: str = "pagina", date: str = "fecha", order: str = "pos"
) -> DataFrame:
    """Articles of the pages up to and including the first whose first article precedes ``oldest``."""
    old = page_summary(articles, page, date, order).filter(F.col("primera_fecha") < F.lit(oldest).cast("date"))
    last = old.agg(F.min(page).alias("last")).scalar()
    return articles.filter(last.isNull() | (F.col(page) <= last))
