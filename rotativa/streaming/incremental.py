"""Streams that keep tables up to date.

Each returns a started query. Offsets and state live in ``checkpoint`` and tables in ``path``, both on storage
that all executors share. Every batch step may be repeated after a failure without changing the
result: a repeated append skips the rows that are stored, and the other tables are versioned by batch.
What a stream has seen is kept in its state store by key, so a batch touches its own keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rotativa.functions.dates import utc_instant, utc_wall
from rotativa.operators.dedup import seen_keys, unseen
from rotativa.operators.rank import rss_ranked
from rotativa.sources.readers import table_or_empty
from rotativa.sources.versions import VersionedTable

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder whose names match ``pattern``, as a stream."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _event_time(stream: DataFrame, time: str) -> DataFrame:
    """The stream with ``time`` as an instant, which watermarks need; wall clocks are taken as UTC."""
    if stream.schema[time].dataType.typeName() == "timestamp_ntz":
        return stream.withColumn(time, utc_instant(time))
    return stream


def drop_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key within ``delay`` of event time; state older than that is dropped."""
    return _event_time(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def known_keys(stored: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The keys of ``stored`` as a stream. They are copied to ``path`` once, so every later start reads the same files."""
    spark = stored.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        stored.select(*keys).distinct().write.mode("overwrite").parquet(path)
    return spark.readStream.schema(stored.select(*keys).schema).parquet(path)


def first_ever(stream: DataFrame, keys: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key that the stream has not had before, by the order columns among rows of one batch.

    Nulls come first, as in a sort. ``known`` is a stream of keys that count as seen, all of them in its first
    batch. Keys stay in the state store for good, with their first row. Write the result in update mode.

    A key's row leaves in the batch that brought the key: then the times of its first and last batch are the
    same. The time is that of the batch, which a repetition of it has too.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    named = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    rows = stream.select(*named, F.struct("*").alias("row"), F.struct(*order).alias("place"), F.current_timestamp().alias("at"))
    if known is not None:
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("row", "place")]
        rows = rows.unionByName(known.select(*named, *nothing, F.timestamp_seconds(F.lit(0)).alias("at")))
    seen = rows.groupBy(*[f"key_{i}" for i in range(len(keys))]).agg(
        F.min_by("row", "place").alias("row"), F.min("at").alias("born"), F.max("at").alias("latest")
    )
    return seen.filter("born = latest AND row IS NOT NULL").select("row.*")


class Attempts:
    """Which batches of a stream were begun, in its checkpoint folder."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self._hadoop, self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs, f"{checkpoint.rstrip('/')}/begun"
        self._fs = self._hadoop.Path(self._folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def repeated(self, batch_id: int) -> bool:
        """True if the batch was begun before; else notes it and forgets the one before it."""
        again = not self._fs.createNewFile(self._hadoop.Path(f"{self._folder}/{batch_id}"))
        self._fs.delete(self._hadoop.Path(f"{self._folder}/{batch_id - 1}"), False)
        return again


def append_unseen(
    stream: DataFrame, path: str, checkpoint: str, order: list[str], key: str = "url", every: str | None = None
) -> StreamingQuery:
    """Append the rows whose key the table does not hold yet, one per key; rows without a key are dropped.

    The table's keys enter the stream's state with its first batch. After that a batch reads nothing of
    the table, unless it is the repetition of one that failed.
    """
    spark = stream.sparkSession
    stored = seen_keys(table_or_empty(spark, path, stream.schema), key)
    known = known_keys(stored, [key], f"{checkpoint.rstrip('/')}/known")
    new = first_ever(stream.filter(F.col(key).isNotNull()), [key], order, known)
    attempts = Attempts(spark, checkpoint)

    def add(batch: DataFrame, batch_id: int) -> None:
        if attempts.repeated(batch_id):
            batch = unseen(batch, table_or_empty(batch.sparkSession, path, batch.schema), order, key).select(*batch.columns)
        batch.write.mode("append").parquet(path)

    return _start(new.writeStream.outputMode("update").foreachBatch(add), checkpoint, every)


def daily_counts(
    stream: DataFrame, path: str, checkpoint: str, time: str, delay: str = "2 days", every: str | None = None
) -> StreamingQuery:
    """Keep ``fecha_dia, count_noticias`` in a versioned table at ``path``, the still open last day included.

    Days older than ``delay`` behind the newest row leave the state and change no more; rows that come later
    than that are dropped. A batch writes its changed days over those of the version before.
    """
    timed = _event_time(stream, time).withWatermark(time, delay)
    days = timed.groupBy(F.window(time, "1 day")).agg(F.count(F.lit(1)).alias("count_noticias"))

    def change(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        changed = batch.select(utc_wall("window.start").cast("date").alias("fecha_dia"), "count_noticias")
        before = table.current()
        if before is not None:
            changed = before.join(changed.select("fecha_dia"), "fecha_dia", "left_anti").unionByName(changed)
        table.write(changed.coalesce(1), batch_id)

    return _start(days.writeStream.outputMode("update").foreachBatch(change), checkpoint, every)


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a versioned table."""
    return VersionedTable(spark, path).current()


def rolling_top(
    stream: DataFrame, path: str, checkpoint: str, n: int = 10, every: str | None = None
) -> StreamingQuery:
    """Keep the top ``n`` entries per source over all polls in a versioned table at ``path``.

    Every (source, title) ever seen stays in the stream's state, so a title that left the top and comes back stays
    what it was. Entries whose title is new join the previous top; ``poll`` puts what was seen in an
    earlier batch first. A batch reads its own entries and the previous top.
    """
    titled = stream.filter(F.trim("title") != "").withColumn("_title", F.lower(F.trim("title")))
    new = first_ever(titled, ["source", "_title"], ["feed_pos", "entry_pos"]).drop("_title")

    def update(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        entries = batch.withColumn("poll", F.lit(batch_id).cast("long"))
        before = table.current()
        if before is not None:
            entries = entries.unionByName(before.select(*entries.columns))
        table.write(rss_ranked(entries, n, seen_order=("poll", "feed_pos", "entry_pos")), batch_id)

    return _start(new.writeStream.outputMode("update").foreachBatch(update), checkpoint, every)
