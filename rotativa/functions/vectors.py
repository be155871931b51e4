"""Vector expressions over ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotativa.functions.text import as_col


def as_doubles(c: Column | str) -> Column:
    return as_col(c).cast("array<double>")


def l2_norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(c), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(c: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    # The one-element array binds the norm once per row instead of once per vector element.
    scaled = F.transform(
        F.array(l2_norm(c)),
        lambda norm: F.transform(as_doubles(c), lambda x: F.when(norm == 0, 0.0).otherwise(x / norm)),
    )
    return F.element_at(scaled, 1)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(c)))
