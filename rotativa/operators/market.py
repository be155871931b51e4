"""Next-day targets of daily features, time-ordered folds, and ridge regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_traded(days: DataFrame, prices: DataFrame, day: str = "fecha", price: str = "cierre") -> DataFrame:
    """``days`` with the last close up to that day and the next one after it, and the return between both.

    Columns ``{price}_previo``, ``{price}_siguiente`` and ``retorno``; days before the first or after the last close
    have nulls. ``prices`` holds one row per traded day (rows without a price don't count) and ``days`` one per
    day, so what passes through one task is the calendar, not the articles.
    """
    before, after = f"{price}_previo", f"{price}_siguiente"
    kept = [c for c in days.columns if c not in (day, before, after, "retorno")]
    quoted = prices.filter(F.col(price).isNotNull()).select(F.col(day).alias("_day"), F.col(price).alias("_price"), F.lit(0).alias("_kind"))
    asked = days.select(F.col(day).alias("_day"), F.lit(None).cast("double").alias("_price"), F.lit(1).alias("_kind"), F.struct(*kept).alias("_row"))
    both = quoted.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    # A close of the day itself is known on that day.
    order = Window.orderBy("_day", "_kind")
    filled = both.withColumns(
        {
            before: F.last("_price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            after: F.first("_price", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).filter("_kind = 1")
    rows = filled.select(F.col("_day").alias(day), "_row.*", before, after)
    return rows.withColumn("retorno", F.try_divide(F.col(after), F.col(before)) - 1)


def time_folds(df: DataFrame, folds: int, day: str = "fecha") -> DataFrame:
    """Rows once per fold, with ``fold`` from 1 and ``parte``: what is learnt lies before what is tested.

    The days are cut into ``folds`` + 1 stretches of equal numbers of days; fold k learns from the first k stretches and is
    tested on the next. ``df`` holds one row per day. Days behind the stretch that is tested are left out of a fold.
    """
    place = F.row_number().over(Window.orderBy(day)) - 1
    stretch = F.floor(place * (folds + 1) / F.count(F.lit(1)).over(Window.partitionBy()))
    numbered = df.withColumn("_stretch", stretch)
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    part = F.when(F.col("_stretch") < F.col("fold"), "aprende").when(F.col("_stretch") == F.col("fold"), "prueba")
    return each.withColumn("parte", part).filter("parte IS NOT NULL").drop("_stretch")


def _moments(columns: list[str]) -> list[Column]:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]]
    return out + [F.sum(F.col(a) * F.col(b)).alias(f"s{columns.index(a)}_{columns.index(b)}") for a, b in pairs]


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 0.0, by: list[str] = ()) -> DataFrame:
    """(by..., n, term, coefficient): least squares with a penalty on the squared coefficients, per group.

    ``intercept`` is not penalised. One aggregate gives all sums and products, with a row per task and group in the
    shuffle; rows with a null in any of the columns are left out. A group whose equations have no solution (as when
    a feature never varies and nothing is penalised) gets the solution of the smallest coefficients.
    """
    names = [*features, target]
    used = df.dropna(subset=names).select(*by, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    # Shifted by the overall means, so that large values with a small spread keep their digits.
    means = used.agg(*[F.avg(f"_{i}").alias(f"m{i}") for i in range(len(names))]).first()
    shift = [m or 0.0 for m in means]
    moved = used.withColumns({f"_{i}": F.col(f"_{i}") - F.lit(m) for i, m in enumerate(shift)})
    sums = moved.groupBy(*by).agg(*_moments([f"_{i}" for i in range(len(names))])).filter("n > 0")
    p = len(features)
    solved = []
    for row in sums.collect():  # a row per group
        n, s = row["n"], np.array([row[f"s{i}"] for i in range(p + 1)])
        cross = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) - np.outer(s, s) / n
        slopes = np.linalg.pinv(cross[:p, :p] + penalty * np.eye(p), hermitian=True) @ cross[:p, p]
        level = shift[p] + s[p] / n - sum(b * (m + t / n) for b, m, t in zip(slopes, shift, s, strict=False))
        group = [row[c] for c in by]
        solved += [(*group, n, name, float(b)) for name, b in zip([*features, "intercept"], [*slopes, level], strict=True)]
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]
    return df.sparkSession.createDataFrame(solved, ", ".join([*kinds, "n bigint, term string, coefficient double"]))


def fold_errors(folds: DataFrame, features: list[str], target: str, penalty: float = 0.0) -> DataFrame:
    """(fold, n_aprende, n_prueba, error, error_base): root mean squares of the tested days' errors.

    ``error_base`` is that of the mean of what was learnt, for comparison. Rows with nulls are left out.
    """
    usable = folds.dropna(subset=[*features, target])
    learnt = usable.filter("parte = 'aprende'")
    models = ridge(learnt, features, target, penalty, ["fold"]).groupBy("fold").pivot("term", [*features, "intercept"]).agg(F.first("coefficient"))
    models = models.withColumnsRenamed({c: f"_b_{c}" for c in [*features, "intercept"]})
    base = learnt.groupBy("fold").agg(F.count(F.lit(1)).alias("n_aprende"), F.avg(target).alias("_mean"))
    tested = usable.filter("parte = 'prueba'").join(F.broadcast(models), "fold").join(F.broadcast(base), "fold")
    guess = reduce(lambda a, c: a + F.col(f"_b_{c}") * F.col(c), features, F.col("_b_intercept"))
    square = lambda c: F.sqrt(F.avg((F.col(target) - c) * (F.col(target) - c)))
    return tested.groupBy("fold", "n_aprende").agg(
        F.count(F.lit(1)).alias("n_prueba"), square(guess).alias("error"), square(F.col("_mean")).alias("error_base")
    )


def lagged_correlations(df: DataFrame, left: list[str], right: list[str], day: str = "fecha", lags: list[int] = (0,)) -> DataFrame:
    """(a, b, lag, n, corr): Pearson correlation of every left column with every right column ``lag`` days later.

    ``df`` holds one row per day. All pairs and lags come from one aggregate; pairs of days with a null are left
    out, and a column that never varies gives null.
    """
    ahead = [df.select((F.date_sub(day, lag) if lag else F.col(day)).alias("_day"), F.lit(lag).alias("lag"), *[F.col(c).cast("double").alias(f"_r_{c}") for c in right]) for lag in lags]
    both = df.select(F.col(day).alias("_day"), *[F.col(c).cast("double").alias(f"_l_{c}") for c in left]).join(reduce(DataFrame.unionAll, ahead), "_day")
    pairs = [(a, b) for a in left for b in right]
    out = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"_l_{a}"), F.col(f"_r_{b}")
        full = x.isNotNull() & y.isNotNull()
        # Spark's own corr fails where a column never varies.
        spread = F.sqrt(F.var_pop(F.when(full, x)) * F.var_pop(F.when(full, y)))
        out += [F.count_if(full).alias(f"n{i}"), F.try_divide(F.covar_pop(x, y), spread).alias(f"c{i}")]
    wide = both.groupBy("lag").agg(*out)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select("lag", F.explode(rows).alias("p")).select("p.a", "p.b", "lag", "p.n", "p.corr")
