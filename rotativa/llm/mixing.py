"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. Within a source, documents stand in the order of their
size; the prefix sums of their expected copies, shifted by one random offset, cross integers, and a
document is taken once per integer that its own step crosses. Neighbours in that order have equal
sizes or nearly so, which keeps the words taken close to the target.

Null texts have size 0 and null sources are a source of their own. Documents of size 0 take part in
the numbering and add no words; texts of any length count whole. An empty table gives an empty result.
Repeated rows are documents of their own. Columns called size, source_size, target or copies are
replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.llm.common import numbered, unit_hash, word_count

MAX_REPEAT = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Target words of each source from a table (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at ``max_repeat``
    times the source's size. With sources in the order of cap over weight, a source is capped when
    its cap is at most its share of what the sources before it leave over.
    """
    everyone = Window.partitionBy()
    by_name = everyone.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    cap = F.col("source_size") * max_repeat
    ranked = weighted.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
    earlier = everyone.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = ranked.withColumn("level", left / rest)
    capped = F.col("ratio") <= F.col("level")
    # Past the first source that is not capped, taking its cap off only lowers the level.
    share = F.max(F.when(~capped, F.col("level"))).over(everyone)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share * F.col("weight"))
    return level.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    seed: str = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, one row per document.

    ``size`` is the number of words of ``text`` unless given. ``keep`` names the columns to carry,
    ``doc_id`` and ``source`` among them; by default all.
    """
    own = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "copies")]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    # The row travels as one column, so that its names cannot meet those used here.
    sized = docs.select(
        F.struct(*own).alias("row"),
        "doc_id",
        "source",
        (word_count() if size is None else size).alias("size"),
        unit_hash(key).alias("place"),
        F.xxhash64("text").alias("tie"),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    offset = unit_hash(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("null"))))
    plan = source_targets(sizes, weights, max_repeat).select(
        F.col("source").alias("_source"), "source_size", "target", offset.alias("_offset")
    )
    # One row per source, as wide as a name and four numbers; Spark broadcasts it while it is small.
    placed = numbered(sized, ["source"], ["size"], "place", ("doc_id", "tie")).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((F.col("_index") + 1) * expected + F.col("_offset")) - F.floor(F.col("_index") * expected + F.col("_offset"))
    return placed.withColumn("copies", F.least(crossed, F.lit(max_repeat))).select("row.*", "size", "source_size", "target", "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """One row per copy taken."""
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(copies))
    return taken.drop("_copy", "size", "source_size", "target", "copies")
