"""Helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of anything but the six ASCII blanks; bytes.split() has the same rule.
WORD = r"[^\x20\x09-\x0D]+"
# A group is split when it holds more than one of this many shares of the table, so a list of such
# groups has at most this many rows, whatever the size of the table.
SHARES = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def word_count(c: str = "text") -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def id_remainder(c: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def give_back() -> None:
    """Lets the allocators of this process return what is free; a worker outlives its tasks, and they keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks, until another operator asks for one."""
    states = sys.__dict__.setdefault("_rotativa_state", {})
    others = [k for k in states if k != name]
    for other in others:
        del states[other]
    if others:
        give_back()
    return states.setdefault(name, {})


def hot_keys(df: DataFrame, keys: list[str], least: int = 64) -> DataFrame:
    """Keys with more than 1/SHARES of all rows and the parts to split them into (``_parts``).

    At most SHARES rows, so the table may be broadcast at any size of the input.
    """
    rows = F.count(F.lit(1)).alias("_rows")
    counted = df.groupBy(*keys).agg(rows)
    share = F.greatest(df.agg(rows).scalar() / SHARES, F.lit(float(least)))
    return counted.filter(F.col("_rows") > share).select(
        *[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)],
        F.ceil(F.col("_rows") / share).cast("int").alias("_parts"),
    )


def with_parts(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_parts``, 1 for keys that aren't split."""
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)]
    joined = df.join(F.broadcast(hot), same, "left")
    return joined.withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop(*[f"_hot_{i}" for i in range(len(keys))])


def numbered(df: DataFrame, group: list[str], size: list[str], place: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``_index``: the place of a row in its group, from 0, in the order of ``size`` and ``place``.

    ``size`` columns hold no nulls; ``ties`` decide between equal places. ``place`` is a number in [0, 1) and spreads rows of equal size. Rows are dealt out by group,
    size and, where such a key is hot, by slices of ``place``; what a single task orders per group
    is the counts of those slices only.
    """
    # Nulls become a value, so that one exchange serves both the join and the window.
    keys = {f"_g{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for i, k in enumerate(group)}
    keyed = df.withColumns({**keys, **{f"_o{i}": F.col(k) for i, k in enumerate(size)}})
    orders = [f"_o{i}" for i in range(len(size))]
    fine = [*keys, *orders]
    cut = with_parts(keyed, fine, hot_keys(keyed, fine))
    cut = cut.withColumn("_slice", F.floor(F.col(place) * F.col("_parts")).cast("int")).drop("_parts")
    slices = cut.groupBy(*fine, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(*orders, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = cut.join(starts, [*fine, "_slice"])
    within = Window.partitionBy(*fine, "_slice").orderBy(place, *ties)
    index = F.col("_start") + F.row_number().over(within) - 1
    return joined.withColumn("_index", index).select(*df.columns, "_index")


# Bits of the filter below, 64 to a row: 524,288 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 25


def possibly_in(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Add ``_maybe``: false only where ``key`` is surely not in the one column of ``keys``.

    A bit per hash, broadcast, keeps rows without a partner out of a shuffle. Its size is fixed; with
    very many keys more rows pass, and the join that must follow gives the same result.
    """

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    bit = "shiftleft(1L, CAST(_at % 64 AS INT))"
    set_ = keys.select(place(F.col(keys.columns[0])).alias("_at")).groupBy(F.floor(F.col("_at") / 64).alias("_word"))
    bits = set_.agg(F.expr(f"bit_or({bit})").alias("_bits"))
    asked = df.withColumn("_at", place(key)).withColumn("_word", F.floor(F.col("_at") / 64))
    joined = asked.join(F.broadcast(bits), "_word", "left")
    return joined.withColumn("_maybe", F.expr(f"coalesce((_bits & {bit}) != 0, false)")).drop("_word", "_at", "_bits")
