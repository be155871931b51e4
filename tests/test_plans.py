"""What reaches the scan and the shuffle."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rotativa.operators import aggregates, dedup, rank
from rotativa.plans import consolidation
from rotativa.plans.driver_tables import news, paper_tables
from rotativa.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "query,columns",
    [
        ("q_count_by_source", "struct<source:string>"),
        ("q_count_by_date", "struct<doc_id:bigint>"),
        ("q_articles_per_day", "struct<doc_id:bigint,source:string>"),
        ("q_nid", "struct<doc_id:bigint,text:string,lang:string,n_chars:bigint>"),
        ("q_written_day", "struct<event_id:bigint,ts:timestamp_ntz>"),
        ("q_day_section_vectors", "struct<vec_id:bigint,embedding:array<float>,label:int>"),
    ],
)
def test_scans_read_only_what_is_needed(spark, query, columns):
    assert f"ReadSchema: {columns}" in plan(QUERIES[query](spark, SF))


def test_source_filters_reach_the_scan(spark):
    tables = paper_tables(spark, SF)
    assert "EqualTo(lang,de)" in plan(consolidation.from_headline(tables["ambito"]))


def test_consolidation_does_not_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["q_consolidate"](spark, SF))


def test_aggregates_are_partial_before_their_shuffle(spark):
    text = plan(aggregates.distinct_by(news(spark, SF), "fecha", "diario"))
    assert text.count("HashAggregate") == 4


def test_seen_keys_read_one_column(spark, tmp_path):
    news(spark, SF).write.parquet(f"{tmp_path}/t")
    assert "ReadSchema: struct<url:string>" in plan(dedup.seen_keys(spark.read.parquet(f"{tmp_path}/t")))


def test_large_top_n_is_cut_per_salt(spark):
    df = news(spark, SF).select("doc_id", "seccion")
    small = plan(rank.top_n(df, ["seccion"], [F.col("doc_id")], 10))
    large = plan(rank.top_n(df, ["seccion"], [F.col("doc_id")], 5000))
    assert small.count("WindowGroupLimit") == 2 and "_salt" not in small
    assert "_salt" in large


@pytest.mark.parametrize("query", ["q_story_articles", "q_headline_articles", "q_score", "q_feature_flow"])
def test_python_steps_run_once(spark, query):
    assert plan(QUERIES[query](spark, SF)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("query", ["q_day_cosine", "q_len_hist", "q_page_progress", "q_page_cutoff", "q_month_windows", "q_base_text"])
def test_no_cross_join(spark, query):
    text = plan(QUERIES[query](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_rows_without_a_key_are_not_new(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "url string, pos int")
    assert dedup.unseen(df, df.limit(0), ["pos"]).count() == 1
