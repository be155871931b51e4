from pyspark.sql import functions as F

from rotativa.llm import common


def test_filter_never_loses_a_key(spark, monkeypatch):
    for bits in (64, 1 << 25):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        rows = spark.range(2000).withColumn("k", F.col("id").cast("string"))
        keys = rows.filter("id % 10 = 0").select("k")
        marked = common.possibly_in(rows, F.col("k"), keys).collect()
        assert len(marked) == 2000
        assert all(r["_maybe"] for r in marked if r["id"] % 10 == 0)
        passed = sum(r["_maybe"] for r in marked)
        assert passed > 1500 if bits == 64 else passed < 210
    nothing = common.possibly_in(rows, F.col("k"), keys.limit(0))
    assert nothing.filter("_maybe").count() == 0 and nothing.count() == 2000


def test_hot_keys_are_few_and_split(spark):
    rows = spark.createDataFrame([(None,)] * 3000 + [("h",)] * 3000 + [(f"k{i}",) for i in range(500)], "k string")
    hot = common.hot_keys(rows, ["k"], least=100)
    assert {(r["_hot_0"], r["_parts"]) for r in hot.collect()} == {(None, 30), ("h", 30)}
    parts = {(r["k"], r["_parts"]) for r in common.with_parts(rows, ["k"], hot).collect()}
    assert (None, 30) in parts and ("h", 30) in parts and ("k1", 1) in parts


def test_ids_and_words(spark):
    row = spark.createDataFrame([(5, "a\x0bb\xa0c  d"), (None, None)], "doc_id bigint, text string")
    found = row.select(common.id_remainder("doc_id", 7).alias("r"), common.word_count().alias("n")).collect()
    assert [(r["r"], r["n"]) for r in found] == [(__import__("zlib").crc32(b"5") % 7, 3), (0, 0)]


def test_another_operator_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    common.worker_state("one")["kept"] = [0]
    calls.clear()
    assert common.worker_state("one") == {"kept": [0]} and not calls
    assert common.worker_state("two") == {} and calls == [1]
    assert common.worker_state("one") == {}
