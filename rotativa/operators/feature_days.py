"""Summaries of flat feature columns per day, paper or any other key, and normalised sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.constants import ENUMS
from rotativa.functions.text import as_col, clean_text

# Accented letters of the papers' language and their plain forms, in the same order.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc"


def fold_text(c: Column | str) -> Column:
    """Lower case without accents and outer or repeated blanks."""
    return F.translate(F.lower(clean_text(as_col(c))), ACCENTED, PLAIN)


def normal_section(c: Column | str, mapping: dict[str, str] | None = None) -> Column:
    """A section name folded, then mapped; names that the mapping doesn't hold stay, empty ones are null."""
    folded = F.nullif(fold_text(c), F.lit(""))
    if not mapping:
        return folded
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, folded), folded)


def feature_summary(flat: DataFrame, keys: list[str], weight: str = "confianza", enums: dict[str, list[str]] = ENUMS) -> DataFrame:
    """One row per key: articles, averages, weighted averages, shares of flags and counts of enum values.

    Numbers give ``avg_`` and ``wavg_`` columns (rows without the number or the weight are left out
    of the latter), flags ``share_``, and each allowed value of an enum column ``n_<column>__<value>``.
    All are partial aggregates: a task sends one row per key.
    """
    out = [F.count(F.lit(1)).alias("n_articles")]
    kinds = {f.name: f.dataType.typeName() for f in flat.schema.fields if f.name not in keys}
    for name, kind in kinds.items():
        c = F.col(name)
        if kind in ("double", "float", "integer", "long"):
            both = c.isNotNull() & F.col(weight).isNotNull()
            total = F.sum(F.when(both, F.col(weight)))
            out.append(F.avg(c).alias(f"avg_{name}"))
            out.append(F.try_divide(F.sum(F.when(both, c * F.col(weight))), total).alias(f"wavg_{name}"))
        elif kind == "boolean":
            out.append(F.avg(c.cast("double")).alias(f"share_{name}"))
    for path, values in enums.items():
        name = path.replace(".", "__")
        if name in kinds:
            out += [F.count_if(F.col(name) == v).alias(f"n_{name}__{v}") for v in values]
    return flat.groupBy(*keys).agg(*out)
