from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rotativa.operators.rank import rss_columns
from rotativa.sources.versions import VersionedTable
from rotativa.streaming import incremental as inc


@pytest.fixture
def arrivals(spark, tmp_path):
    """Three files that arrive one after the other."""
    folder = tmp_path / "in"
    batches = [
        [("a", 0, datetime(2025, 1, 1, 10)), ("a", 1, datetime(2025, 1, 1, 11)), ("b", 2, datetime(2025, 1, 1, 23, 59))],
        [("b", 3, datetime(2025, 1, 2, 1)), ("c", 4, datetime(2025, 1, 2, 2))],
        [("a", 5, datetime(2025, 1, 3, 1)), ("d", 6, datetime(2025, 1, 3, 2))],
    ]
    import time

    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "url string, pos int, ts timestamp_ntz").coalesce(1)
        df.write.mode("append").parquet(str(folder))
        time.sleep(1.1 if i < 2 else 0)
    return str(folder)


def stream(spark, arrivals):
    return inc.table_stream(spark, arrivals, "*.parquet", files_per_batch=1)


def test_append_unseen(spark, arrivals, tmp_path):
    path, offsets = f"{tmp_path}/table", f"{tmp_path}/offsets"
    inc.append_unseen(stream(spark, arrivals), path, offsets, ["pos"]).awaitTermination()
    assert sorted((r["url"], r["pos"]) for r in spark.read.parquet(path).collect()) == [("a", 0), ("b", 2), ("c", 4), ("d", 6)]
    # Reading everything again under new offsets adds nothing.
    inc.append_unseen(stream(spark, arrivals), path, f"{tmp_path}/offsets2", ["pos"]).awaitTermination()
    assert spark.read.parquet(path).count() == 4


def test_keys_of_the_table_and_of_earlier_runs_are_known(spark, arrivals, tmp_path):
    path, offsets = f"{tmp_path}/table", f"{tmp_path}/offsets"
    spark.createDataFrame([("d", 99, None), (None, 98, None)], "url string, pos int, ts timestamp_ntz").write.parquet(path)
    inc.append_unseen(stream(spark, arrivals), path, offsets, ["pos"]).awaitTermination()
    assert sorted((r["url"], r["pos"]) for r in spark.read.parquet(path).filter("url IS NOT NULL").collect()) == [("a", 0), ("b", 2), ("c", 4), ("d", 99)]
    more = [("a", 20, datetime(2025, 1, 4)), ("e", 22, None), ("e", 21, datetime(2025, 1, 4, 0, 0, 0, 123456)), (None, 23, None)]
    spark.createDataFrame(more, "url string, pos int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(arrivals)
    query = inc.append_unseen(stream(spark, arrivals), path, offsets, ["pos"])
    query.awaitTermination()
    # Started again, it reads the new file alone.
    assert sum(p["numInputRows"] for p in query.recentProgress) == 4
    added = spark.read.parquet(path).filter("pos > 19 AND pos < 90").collect()
    assert [(r["url"], r["pos"], r["ts"]) for r in added] == [("e", 21, datetime(2025, 1, 4, 0, 0, 0, 123456))]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    attempts = inc.Attempts(spark, f"{tmp_path}/c")
    assert [attempts.repeated(0), attempts.repeated(0), attempts.repeated(1), attempts.repeated(1)] == [False, True, False, True]
    assert not attempts.repeated(2)


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", keep=2)
    assert table.current() is None
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert [table.write(rows(1)), table.write(rows(2, 3))] == [0, 1]
    before = table.current()
    assert table.write(rows(9), version=1) == 1 and sorted(r["x"] for r in table.current().collect()) == [2, 3]
    assert table.write(rows(4)) == 2 and table.versions() == [1, 2]
    assert sorted(r["x"] for r in before.collect()) == [2, 3]

    # A writer that dies before the pointer leaves the version before it.
    rows(5).write.parquet(f"{tmp_path}/t/data-000000000003-dead")
    assert [r["x"] for r in VersionedTable(spark, f"{tmp_path}/t").current().collect()] == [4]
    assert table.write(rows().limit(0)) == 3 and table.current().count() == 0


def test_late_rows_change_no_closed_day(spark, tmp_path):
    folder, path, offsets = f"{tmp_path}/in", f"{tmp_path}/days", f"{tmp_path}/offsets"
    import time

    for hours in ([1], [24 * 10], [2, 24 * 10 + 1]):  # the last file's first row is ten days late
        rows = [(datetime(2025, 1, 1 + h // 24, h % 24),) for h in hours]
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)
        inc.daily_counts(inc.table_stream(spark, folder, "*.parquet"), path, offsets, "ts").awaitTermination()
        time.sleep(1.1)
    found = {r["fecha_dia"].day: r["count_noticias"] for r in inc.latest_version(spark, path).collect()}
    assert found == {1: 1, 11: 2}


def test_daily_counts_include_the_open_day(spark, arrivals, tmp_path):
    path = f"{tmp_path}/days"
    inc.daily_counts(stream(spark, arrivals), path, f"{tmp_path}/offsets", "ts").awaitTermination()
    assert {(r["fecha_dia"], r["count_noticias"]) for r in inc.latest_version(spark, path).collect()} == {
        (date(2025, 1, 1), 3), (date(2025, 1, 2), 2), (date(2025, 1, 3), 2)
    }


def test_repeats_within_the_delay(spark, arrivals, tmp_path):
    path = f"{tmp_path}/kept"
    kept = inc.drop_repeats(stream(spark, arrivals), ["url"], "ts", "30 days").select("url")
    kept.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/o").trigger(availableNow=True).start(path).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_rolling_top(spark, arrivals, tmp_path):
    path = f"{tmp_path}/top"
    entries = stream(spark, arrivals).select(
        F.lit("s").alias("source"), F.lit(0).alias("feed_pos"), F.col("pos").alias("entry_pos"), F.col("url").alias("title"),
        F.lit("").alias("link"), F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")).alias("published"),
        F.lit("2025-01-09").cast("timestamp").alias("ingested_at"),
    )
    inc.rolling_top(entries, path, f"{tmp_path}/offsets", n=3).awaitTermination()
    top = rss_columns(inc.latest_version(spark, path)).orderBy("rank_in_source")
    # "a" keeps its first date although a newer copy arrives last.
    assert [(r["rank_in_source"], r["title"], r["date"]) for r in top.collect()] == [
        (1, "d", "2025-01-02"), (2, "c", "2025-01-01"), (3, "b", "2025-01-01")
    ]


def test_first_rows_of_keys_are_found_without_python(spark, arrivals):
    new = inc.first_ever(stream(spark, arrivals), ["url"], ["pos"])
    plan = new._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Python" not in plan and new.columns == ["url", "pos", "ts"]
