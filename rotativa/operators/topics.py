"""Topics: a table of counts factorised into non-negative parts by alternating updates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.operators.rank import top_n
from rotativa.operators.terms import terms_of
from rotativa.session import materialize

# What a divisor is at least.
TINY = 1e-12


def term_cells(df: DataFrame, day: str, text: str) -> DataFrame:
    """(row, col, x): how often each term occurs on each day; rows without a day don't count."""
    words = df.filter(F.col(day).isNotNull()).select(F.col(day).cast("string").alias("row"), F.explode(terms_of(text)).alias("col"))
    return words.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("x"))


def _start(name: str, i: int) -> Column:
    """A number from 0.5 to 1.5 that depends on the name and the topic alone."""
    digest = F.md5(F.concat(F.lit(f"{i}:"), F.col(name)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0 + 0.5


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


class Factors:
    """``rows`` (row, t0, t1, ...), ``cols`` (col, t0, ...) and the squared error after each round."""

    def __init__(self, cells: DataFrame, topics: int):
        self.cells, self.names = materialize(cells.select("row", "col", "x"), "cells"), [f"t{i}" for i in range(topics)]
        first: Callable[[str], DataFrame] = lambda key: self.cells.select(key).distinct().select(key, *[_start(key, i).alias(t) for i, t in enumerate(self.names)])
        self.rows, self.cols = materialize(first("row"), "topic-rows"), materialize(first("col"), "topic-cols")
        self.size = self.cells.agg(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).first()[0]
        self.errors: list[float] = []

    def gram(self, side: DataFrame) -> np.ndarray:
        """Products of the topics' columns, summed over all rows of a side."""
        k = len(self.names)
        sums = [F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a in self.names for b in self.names]
        return np.array(side.agg(*sums).first()).reshape(k, k)

    def against(self, key: str) -> DataFrame:
        """(key, n0, n1, ...): each row's (or column's) cells times the other side's topics."""
        other, by = (self.rows, "row") if key == "col" else (self.cols, "col")
        met = self.cells.join(other, by)
        return met.groupBy(key).agg(*[F.sum(F.col("x") * F.col(t)).alias(f"n{i}") for i, t in enumerate(self.names)])

    def improved(self, key: str) -> DataFrame:
        side, other = (self.cols, self.rows) if key == "col" else (self.rows, self.cols)
        gram = self.gram(other)
        held = [_sum([F.lit(float(gram[i, j])) * F.col(t) for j, t in enumerate(self.names)]) for i in range(len(self.names))]
        new = [(F.col(t) * F.col(f"n{i}") / F.greatest(held[i], F.lit(TINY))).alias(t) for i, t in enumerate(self.names)]
        return materialize(side.join(self.against(key), key).select(key, *new), f"topic-{key}s")

    def round(self) -> None:
        self.cols = self.improved("col")
        self.rows = self.improved("row")
        fit = self.cells.join(self.rows, "row").join(self.cols.withColumnsRenamed({t: f"c_{t}" for t in self.names}), "col")
        product = fit.agg(F.coalesce(F.sum(F.col("x") * _sum([F.col(t) * F.col(f"c_{t}") for t in self.names])), F.lit(0.0))).first()[0]
        self.errors.append(float(self.size - 2 * product + (self.gram(self.rows) * self.gram(self.cols)).sum()))


def factorise(cells: DataFrame, topics: int, rounds: int = 50, tolerance: float = 0.0) -> Factors:
    """Non-negative factors of (row, col, x) whose product is close to the cells, absent ones being 0.

    Lee and Seung's multiplicative updates: every round improves the columns, then the rows, each by one join with the
    cells and one aggregate; only ``topics`` squared numbers come to the driver. The squared error never
    grows. Stops after ``rounds``, or when a round takes off less than ``tolerance`` of the error. The start depends on names alone,
    so reruns agree. ``x`` must not be negative or null; an empty table gives empty factors.
    """
    found = Factors(cells, topics)
    for _ in range(rounds):
        found.round()
        if len(found.errors) > 1 and found.errors[-2] - found.errors[-1] < tolerance * found.errors[-2]:
            break
    return found


def topic_terms(factors: Factors, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight): each topic's strongest terms, as shares of the topic; ties in the order of terms."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("topic"), F.col(t).alias("w")) for i, t in enumerate(factors.names)]))
    long = factors.cols.select(F.col("col").alias("term"), each.alias("p")).select("p.topic", "term", "p.w")
    # A row per topic.
    totals = long.groupBy("topic").agg(F.sum("w").alias("total"))
    shares = long.join(F.broadcast(totals), "topic").withColumn("weight", F.round(F.try_divide("w", "total"), 9))
    return top_n(shares, ["topic"], [F.desc("weight"), F.col("term")], n).select("topic", "rank", "term", "weight")


def topic_shares(factors: Factors) -> DataFrame:
    """(row, topic, share): how a day's articles are made up of topics, in units of each topic's terms."""
    sums = factors.cols.agg(*[F.coalesce(F.sum(t), F.lit(0.0)) for t in factors.names]).first()
    scaled = [(F.col(t) * F.lit(float(s))).alias(t) for t, s in zip(factors.names, sums, strict=True)]
    rows = factors.rows.select("row", *scaled)
    total = _sum([F.col(t) for t in factors.names])
    each = F.array(*[F.struct(F.lit(i).alias("topic"), F.try_divide(F.col(t), total).alias("share")) for i, t in enumerate(factors.names)])
    return rows.select("row", F.explode(each).alias("p")).select("row", "p.topic", "p.share")
