"""Exact de-duplication against a persistent index of text digests.

The index is a table of one row per different text: the SHA-256 of the normalised text and the row
that brought it first. It is bucketed and sorted by digest, so a batch of new rows is shuffled to the
index's buckets and merged with them, while the index itself isn't shuffled. What the anti-join leaves is
new, one row per text, and is appended to the same buckets; ``compact`` puts the files of many
appends into one per bucket again.

Texts are equal when they are identical after each run of ASCII blanks is replaced by one space. A
null text counts as empty, and empty texts are equal too. Of equal texts in one batch, the smallest
doc_id stays, a null id only among nulls; of rows that share id and text, one stays. A text that the
index holds already is a copy, whatever its id. Very long texts are read whole. An empty table
changes nothing. Other columns pass through ``add`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotativa.llm.common import hot_keys, text_or_empty, with_parts
from rotativa.session import materialize, shared_dir

BLANKS = r"[\x20\x09-\x0D]+"
ENTRY = "digest BINARY, keep_id BIGINT, keep_row BIGINT"


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), BLANKS, " ").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, as a bucketed table at ``path``.

    A session names the table by its path; a later session opens the same path again, with the
    number of buckets that is stored beside it. Writes go through Spark's commit protocol. A batch
    that was appended and is sent again finds all its digests and adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"rotativa_digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        stored = self._stored_buckets()
        self.buckets = stored or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/meta")
        self._open("entries" if not stored else self._stored_folder())

    def _stored_buckets(self) -> int | None:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return None
        return self.spark.read.parquet(f"{self.path}/meta").first()["buckets"]

    def _stored_folder(self) -> str:
        """The newest complete copy of the entries."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("entries-") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}.done"))]
        return max(done, key=lambda n: int(n.split("-")[1]), default="entries")

    def _open(self, folder: str) -> None:
        self.folder = folder
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # the files stay, the table is external
        self.spark.sql(
            f"CREATE TABLE {self.name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )

    def entries(self) -> DataFrame:
        """(digest, keep_id, keep_row): one row per different text."""
        return self.spark.table(self.name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose ``digest`` the index doesn't hold, by merging with its sorted buckets."""
        return rows.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, entries: DataFrame) -> None:
        """Add entries that the index doesn't hold; each bucket gets one more file."""
        dealt = entries.select("digest", "keep_id", "keep_row").repartition(self.buckets, "digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Write one sorted file per bucket into a new folder; readers change over when it is complete."""
        number = int(self.folder.split("-")[1]) + 1 if "-" in self.folder else 1
        new = f"entries-{number}"
        copy = f"{self.name}_{number}"
        self.spark.sql(f"DROP TABLE IF EXISTS {copy}")
        self.spark.sql(
            f"CREATE TABLE {copy} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{new}'"
        )
        self.entries().repartition(self.buckets, "digest").write.mode("overwrite").insertInto(copy)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{new}.done")
        self.spark.sql(f"DROP TABLE {copy}")
        self._open(new)


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per ``digest``: the smallest (doc_id, row), null ids last. Each task keeps its own first."""
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    return rows.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def learn(index: DigestIndex, rows: DataFrame) -> None:
    """Add what is new in ``rows`` (doc_id, digest, row) to the index."""
    new = index.unseen(first_rows(rows))
    index.append(new.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))


def add(index: DigestIndex, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with texts that are new, one for each, after adding them to the index.

    The rows are written to the shared folder before the index grows, so the result doesn't change
    when it is read again later.
    """
    held = docs.select(F.struct("*").alias("value"), F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(text).alias("digest"))
    new = materialize(index.unseen(first_rows(held.withColumn("row", F.monotonically_increasing_id()))), "new-texts")
    index.append(new.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")))
    return new.select("value.*")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, row), written to the shared folder; ``row`` tells equal rows apart."""
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(text).alias("digest"))
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "digests")


def resolve(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """``rows`` of ``digests`` with ``keep_id``, ``group_size`` and ``kept``; the index must hold their texts.

    ``group_size`` counts the rows given here. A row stays if it is the one that the index names.
    Counts come before any join, and a text with very many copies is split to get its group.
    """
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    named = sizes.join(index.entries().hint("merge"), "digest")
    hot = hot_keys(rows, ["digest"])
    parted = with_parts(rows, ["digest"], hot).withColumn("_part", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int"))
    copied = with_parts(named, ["digest"], hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    joined = parted.join(copied.drop("_parts"), ["digest", "_part"])
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_row") == F.col("row"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def exact_groups(docs: DataFrame, text: str = "text", path: str | None = None, batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    The ids are dealt to ``batches`` ranges, which arrive one after the other at a new index, so each
    but the first is merged with what the earlier ones left there. Null ids come with the last.
    """
    spark = docs.sparkSession
    rows = digests(docs, text)
    index = DigestIndex(spark, path or shared_dir(spark, "digest-index"))
    shares = F.array(*[F.lit(n / batches) for n in range(1, batches)])
    cuts = (rows.select(F.percentile_approx("doc_id", shares)).first()[0] or []) if batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.col("doc_id") > low if low is not None else F.lit(True)
        below = F.col("doc_id") <= high if high is not None else F.lit(True)
        learn(index, rows.filter(F.coalesce(above & below, F.lit(high is None))))
    return resolve(index, rows)
