import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.operators import aggregates, dedup, filters, joins, paging, rank, sampling, schema_ops
from rotativa.plans import consolidation
from rotativa.schemas import AMBITO, NEWS, RAW_ARTICLE, SITEMAP_ARTICLE


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def skewed():
    """Rows (key, pos, value) where one key holds a third of them."""
    rng = random.Random(7)
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(400)}", i, rng.randrange(10_000)) for i in range(6000)]


@pytest.fixture(scope="module")
def skewed_df(spark, skewed):
    shuffled = skewed[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "url string, pos int, value int").repartition(7)


def test_first_seen_matches_brute_force(skewed, skewed_df):
    first = {}
    for key, pos, value in skewed:
        first.setdefault(key, (key, pos, value))
    assert sorted(rows(dedup.first_url(skewed_df, ["pos"]))) == sorted(first.values())


def test_first_seen_is_cut_before_the_shuffle(skewed_df):
    plan = dedup.first_url(skewed_df, ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_result_does_not_depend_on_partitions(skewed_df):
    wide, narrow = skewed_df.repartition(13), skewed_df.coalesce(1)
    for operator in (
        lambda df: dedup.first_url(df, ["pos"]),
        lambda df: rank.top_n(df, ["url"], [F.col("value").desc(), F.col("pos")], 3),
        lambda df: sampling.sample_n(df, 10, "pos"),
    ):
        assert sorted(rows(operator(wide))) == sorted(rows(operator(narrow)))


def test_title_dedup_keeps_the_first_read(spark):
    df = spark.createDataFrame(
        [("a", "Hola", 0, 1), ("a", " HOLA ", 0, 2), ("b", "hola", 0, 0), ("a", "  ", 0, 0), ("a", "Á", 1, 0), ("a", "á", 0, 9)],
        "source string, title string, feed_pos int, entry_pos int",
    )
    kept = {(r["source"], r["title"]) for r in dedup.first_title(df).collect()}
    assert kept == {("a", "Hola"), ("b", "hola"), ("a", "á")}


def test_unseen_matches_brute_force_and_is_idempotent(spark, skewed, skewed_df):
    stored_keys = [f"k{i}" for i in range(0, 400, 3)] * 5
    stored = spark.createDataFrame([(k,) for k in stored_keys], "url string")
    new = dedup.unseen(skewed_df, stored, ["pos"]).cache()
    first = {}
    for key, pos, value in skewed:
        first.setdefault(key, pos)
    assert {(r["url"], r["pos"]) for r in new.collect()} == {(k, p) for k, p in first.items() if k not in set(stored_keys)}
    assert dedup.unseen(skewed_df, stored.union(new.select("url")), ["pos"]).count() == 0


@pytest.mark.parametrize("n", [1, 10, 1500])
def test_top_n_matches_brute_force(skewed, skewed_df, n):
    groups = defaultdict(list)
    for key, pos, value in skewed:
        groups[key].append((-value, pos))
    expected = {(key, pos, i + 1) for key, g in groups.items() for i, (_, pos) in enumerate(sorted(g)[:n])}
    found = rank.top_n(skewed_df, ["url"], [F.col("value").desc(), F.col("pos")], n)
    assert {(r["url"], r["pos"], r["rank"]) for r in found.collect()} == expected


def test_rss_top(spark):
    entries = spark.createDataFrame(
        [
            ("a", 0, 0, "viejo", "l0", "Wed, 01 Jan 2025 10:00:00 GMT"),
            ("a", 0, 1, "x", "l1", "Thu, 02 Jan 2025 10:00:00 GMT"),
            ("a", 1, 0, "X", "l2", "Fri, 03 Jan 2025 10:00:00 GMT"),
            ("a", 1, 1, "empate", "l3", "2025-01-02T07:00:00-03:00"),
            ("a", 1, 2, "sin fecha", "l4", None),
            ("a", 1, 3, "", "l5", "Fri, 03 Jan 2025 10:00:00 GMT"),
            ("b", 0, 0, "otro", "", "Thu, 02 Jan 2025 01:00:00 GMT"),
        ],
        "source string, feed_pos int, entry_pos int, title string, link string, published string",
    ).withColumn("ingested_at", F.lit("2025-01-05T00:00:00Z").cast("timestamp"))
    top = rank.rss_top(entries, 3).orderBy("source", "rank_in_source")
    assert rows(top) == [
        ("2025-01-04", "2025-01-04T21:00:00-03:00", "a", 1, "sin fecha", "l4"),
        ("2025-01-02", "2025-01-02T07:00:00-03:00", "a", 2, "x", "l1"),
        ("2025-01-02", "2025-01-02T07:00:00-03:00", "a", 3, "empate", "l3"),
        ("2025-01-01", "2025-01-01T22:00:00-03:00", "b", 1, "otro", ""),
    ]


def test_date_window_and_border_days(spark):
    days = ["2024-12-31", "2025-01-01", "2025-04-30", "2025-05-01", None]
    df = spark.createDataFrame([(d,) for d in days], "fecha string").withColumn("fecha", F.col("fecha").cast("date"))
    assert [str(r[0]) for r in filters.date_window(df).collect()] == ["2025-01-01", "2025-04-30"]
    assert {str(r[0]) for r in filters.not_in(df).collect()} == {"2025-01-01", "2025-04-30", "None"}


def test_source_selection(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert rows(filters.keep_sources(df, ["b", "zz"], ["a", "b", "c"])) == [("b",)]
    assert filters.keep_sources(df, [], ["a", "b"]).count() == 2
    with pytest.raises(ValueError):
        filters.keep_sources(df, ["zz"], ["a"])
    assert rows(joins.in_table(df, spark.createDataFrame([("a",), ("a",)], "source string"), "source")) == [("a",)]


def test_month_overlap(spark):
    locs = ["s-2024-12.xml", "s-2025-01.xml", "s-2025-03.xml", "s-2025-04.xml", "s-2025-13.xml", "otro"]
    df = spark.createDataFrame([(loc,) for loc in locs], "loc string")
    found = filters.months_overlapping(df, filters.month_from_text(F.col("loc")), "2025-01-31", "2025-03-01")
    assert sorted(r[0] for r in found.collect()) == ["s-2025-01.xml", "s-2025-03.xml"]


def test_month_windows_match_brute_force(spark):
    months = [date(2024 + m // 12, m % 12 + 1, 1) for m in range(30)]
    windows = [("a", date(2024, 1, 31), date(2024, 3, 1)), ("b", date(2025, 5, 15), date(2025, 5, 15)), ("c", date(2030, 1, 1), date(2030, 2, 1))]
    found = filters.month_window_join(
        spark.createDataFrame([(m,) for m in months], "mes date"), "mes", spark.createDataFrame(windows, "w string, start date, end date")
    )

    def last(m):
        return (m.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)

    expected = {(m, w) for m in months for w, s, e in windows if not (last(m) < s or m > e)}
    assert {(r["mes"], r["w"]) for r in found.collect()} == expected


def test_hot_months_are_split(spark):
    rows = [(date(2025, 1, 1), i) for i in range(90)] + [(None, 500), (date(2025, 2, 1), 501)]
    df = spark.createDataFrame(rows, "mes date, k int")
    windows = spark.createDataFrame([("a", date(2024, 12, 5), date(2025, 1, 2)), ("b", date(2025, 1, 1), date(2025, 2, 1))], "w string, start date, end date")
    found = filters.month_window_join(df, "mes", windows, small=20).collect()
    assert sorted((r["k"], r["w"]) for r in found) == sorted([(i, w) for i in range(90) for w in "ab"] + [(501, "b")])


def test_quarantine(spark):
    df = spark.createDataFrame([("2025-01-01",), ("nada",), (None,)], "f string")
    good, bad = filters.good_and_bad_dates(df, "f")
    assert rows(good) == [(date(2025, 1, 1),)]
    assert {r[0] for r in bad.collect()} == {"nada", None}


def test_schema_report(spark):
    tables = {
        "clarin": spark.createDataFrame([], RAW_ARTICLE),
        "ambito": spark.createDataFrame([("f", "t", "r", "a", "u", "s")], AMBITO),
    }
    expected = ["diario", "fecha", "titulo", "contenido", "url", "seccion"]
    report = schema_ops.schema_report(tables, expected)
    assert ("ambito", "resumen", "extra") in rows(report)
    assert ("clarin", "seccion", "missing") in rows(report)
    assert report.count() == 9
    sized = schema_ops.schema_drift_rows(tables, expected)
    assert {(r["source"], r["n_rows"]) for r in sized.collect()} == {("clarin", 0), ("ambito", 1)}


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert schema_ops.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="zz"):
        schema_ops.require_columns(df, ["a", "zz"])
    assert schema_ops.select_present(df, ["a"], ["zz", "b"]).columns == ["a", "b"]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "a int, b string")
    assert rows(schema_ops.profile(df)) == [("a", "int", 3, 3), ("b", "string", 1, 3)]


def test_consolidation(spark):
    ambito = consolidation.from_headline(
        spark.createDataFrame([("2025-01-05 10:30:00", "t", "r", "a", "u1", "opinion"), ("No encontrada", "t", "r", "a", "u2", "opinion")], AMBITO)
    )
    clarin = consolidation.from_story(spark.createDataFrame([("Clarín", "2025-04-30", "t", "c", "l1"), ("Clarín", "2025-05-01", "t", "c", "l2")], RAW_ARTICLE))
    linked = consolidation.from_linked(
        spark.createDataFrame([("1", "politica", "2025-01-31T22:30:00-03:00", "t", "u3", None, "x", 200), ("2", "p", None, "t", "u4", None, "x", 200)], SITEMAP_ARTICLE)
    )
    merged = consolidation.consolidate([ambito, clarin, linked, clarin])
    assert [(f.name, f.dataType) for f in merged.schema] == [(f.name, f.dataType) for f in NEWS]
    assert Counter(map(lambda r: (r["diario"], str(r["fecha"]), r["url"], r["seccion"]), merged.collect())) == {
        ("Ámbito Financiero", "2025-01-05", "u1", "opinion"): 1,
        ("Clarín", "2025-04-30", "l1", "economia"): 2,
        ("La Nación", "2025-01-31", "u3", "politica"): 1,
    }
    missing = schema_ops.conform(ambito.drop("seccion"), NEWS)
    assert missing.filter("seccion is null").count() == 2
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), ("a", None)], "k string, v int")
    assert rows(aggregates.value_counts(df, "k")) == [("a", 3), ("b", 1)]
    assert rows(aggregates.counts_by(df, "k")) == [("a", 3), ("b", 1)]
    assert rows(aggregates.distinct_by(df, "k", "v")) == [("a", 1), ("b", 1)]
    assert rows(aggregates.total_rows(df)) == [(5,)]


@pytest.mark.parametrize("values", [[0, 1, 2, 40], [5, 5, 5], [1.5, -3.25, 7, 7, None], list(range(1000))])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    bars = aggregates.histogram(df, "x").collect()
    counts, edges = np.histogram([v for v in values if v is not None], bins=40)
    assert [b["n"] for b in bars] == counts.tolist()
    assert np.allclose([b["left_edge"] for b in bars] + [bars[-1]["right_edge"]], edges)


def test_base_text(spark):
    schema = "titulo string, bajada string, texto string"
    some = spark.createDataFrame([("T", "b", "x"), ("T", "b", None), (None, None, None)], schema)
    assert [r["texto_base"] for r in aggregates.with_base_text(some).collect()] == ["x", "", ""]
    assert [r["texto_base"] for r in aggregates.with_base_text(some, per_row=True).collect()] == ["x", "T b", ""]
    none = some.withColumn("texto", F.lit(None).cast("string"))
    assert [r["texto_base"] for r in aggregates.with_base_text(none).collect()] == ["T b", "T b", ""]
    assert [r["texto_base"] for r in aggregates.with_base_text(some.drop("texto")).collect()] == ["T b", "T b", ""]
    assert [r["texto_base"] for r in aggregates.with_base_text(some.drop("texto", "bajada")).collect()] == ["T", "T", ""]


def test_running_total_over_several_levels(spark):
    rows = [(i * 7 % 5000, i % 9 if i % 5 else None) for i in range(900)] + [(35, 100), (-3, 4)]
    df = spark.createDataFrame(rows, "pagina bigint, n bigint")
    for levels in (1, 2, 4):
        found = paging.running_total(df, "pagina", "n", "total", bucket=4, levels=levels).collect()
        assert len(found) == len(rows)
        assert all(r["total"] == sum(n or 0 for p, n in rows if p <= r["pagina"]) for r in found)


def test_running_total_matches_brute_force(spark):
    rng = random.Random(3)
    pages = sorted(rng.sample(range(10_000), 500))
    values = {p: rng.randrange(9) for p in pages}
    df = spark.createDataFrame(list(values.items()), "pagina int, n int").repartition(5)
    found = {r["pagina"]: r["total"] for r in paging.running_total(df, "pagina", "n", "total", bucket=64).collect()}
    total, expected = 0, {}
    for p in pages:
        total += values[p]
        expected[p] = total
    assert found == expected


def test_page_progress_and_cutoff(spark):
    d = date
    df = spark.createDataFrame(
        [(1, 0, d(2025, 1, 3)), (1, 1, d(2024, 12, 1)), (2, 2, d(2025, 1, 1)), (3, 5, d(2024, 12, 30)), (3, 4, d(2024, 12, 31)), (4, 6, d(2025, 2, 1)), (5, 7, d(2024, 1, 1))],
        "pagina int, pos int, fecha date",
    )
    progress = paging.page_progress(df, 10).orderBy("pagina").collect()
    assert [(r["pagina"], r["n_nuevas"], str(r["primera_fecha"]), r["total_urls"]) for r in progress][:3] == [
        (1, 2, "2025-01-03", 12), (2, 1, "2025-01-01", 13), (3, 2, "2024-12-31", 15)
    ]
    assert {r["pagina"] for r in paging.until_old_page(df, "2025-01-01").collect()} == {1, 2, 3}
    assert paging.until_old_page(df, "2000-01-01").count() == 7


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    sample = {r["k"] for r in sampling.sample_n(df, 10, "k", 42).collect()}
    assert len(sample) == 10
    assert sample == {r["k"] for r in sampling.sample_n(df.repartition(9), 10, "k", 42).collect()}
    assert sample != {r["k"] for r in sampling.sample_n(df, 10, "k", 43).collect()}
    assert rows(sampling.first_n(df, 2, [F.col("k").desc()])) == [(999,), (998,)]
    assert sampling.sample_n(df, 5000, "k").count() == 1000


def test_page_lookup_keeps_listing_rows(spark):
    listing = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 50), ("c", 51)], "link string, n int")
    pages = spark.createDataFrame([("a", 200, "x"), ("a", 404, "y"), ("b", 200, "z"), ("d", 200, "w")], "url string, status int, html string")
    found = joins.lookup_pages(listing, pages)
    assert Counter(r["html"] for r in found.collect()) == {"x": 50, "z": 1}


def test_backfill_by_key(spark):
    df = spark.createDataFrame([("1", "", None), ("2", "d", "s")], "url string, diario string, seccion string")
    source = spark.createDataFrame([("1", "D", "S"), ("2", "D", "S")], "url string, diario string, seccion string")
    assert sorted(rows(joins.backfill(df, source, "url", ["diario", "seccion"]))) == [("1", "D", "S"), ("2", "d", "s")]


@pytest.mark.parametrize("small", [50, 100_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_with_a_hot_key_matches_brute_force(spark, skewed, skewed_df, how, small):
    one = {key: i for i, key in enumerate(sorted({k for k, _, _ in skewed})) if i % 2 == 0 or key == "hot"}
    other = spark.createDataFrame(list(one.items()), "url string, n int")
    found = Counter(rows(joins.join_one(skewed_df, other, ["url"], how, small)))
    if how == "left_semi":
        expected = Counter(r for r in skewed if r[0] in one)
    else:
        expected = Counter((*r, one.get(r[0])) for r in skewed if how == "left" or r[0] in one)
    assert found == expected


def test_hot_keys_are_split(skewed_df):
    hot = joins.hot_keys(skewed_df, ["url"], small=50)
    assert [r["url"] for r in hot.collect()] == ["hot"]
    split = joins.split_rows(skewed_df, hot, ["url"]).filter("url = 'hot'").groupBy("_part").count().collect()
    assert len(split) > 30 and max(r["count"] for r in split) < 150
    assert joins.hot_keys(skewed_df, ["url"]).count() == 0


def test_page_lookup_with_a_hot_link(spark, skewed_df):
    pages = spark.createDataFrame([(f"k{i}", 200 + i % 2, f"p{i}") for i in range(400)] + [("hot", 404, "b"), ("hot", 200, "a")], "url string, status int, html string")
    found = joins.lookup_pages(skewed_df.withColumnRenamed("url", "link"), pages, small=50)
    assert found.count() == skewed_df.count()
    assert {r["html"] for r in found.filter("url = 'hot'").select("html").distinct().collect()} == {"a"}
