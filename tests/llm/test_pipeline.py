"""Each stage of the pipeline on a small corpus, against what a plain version gives."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from rotativa.llm.packing import tokenizer_path
from rotativa.session import BATCH_ROWS, materialize
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dup import brute_classes


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ten", "sur"]) for _ in range(r.randint(1, 3)))
    rows, labels = [], []
    for i in range(600):
        words, toxic = [word() for _ in range(r.randint(15, 80))], i % 5 == 0
        if toxic:
            for _ in range(5):
                words[r.randrange(len(words))] = "vile"
        if i % 7 == 0:
            words.insert(3, f"user{i}@mail.example.com")
        text = " ".join(words)
        rows.append((i, text, "en", r.choice(["a", "a", "a", "b", "c"]), len(text)))
        labels.append((i, 0, int(toxic)))
    rows += [(1000 + i, rows[i][1] + " more", "en", "b", rows[i][4] + 5) for i in range(1, 60) if i % 5]
    sf = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs.collect(), "sf": sf, "labels": dict((i, t) for i, _, t in labels)}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_toxic_documents_go(stages):
    kept = {r["doc_id"] for r in stages["toxicity"]}
    toxic = {i for i, t in stages["labels"].items() if t}
    clean = {r["doc_id"] for r in stages["documents"]} - toxic
    assert len(kept & toxic) <= 0.1 * len(toxic)
    assert len(kept & clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(stages):
    classes = brute_classes({r["doc_id"]: r["text"] for r in stages["toxicity"]})
    assert sorted(r["doc_id"] for r in stages["near_duplicates"]) == sorted(set(classes.values()))


def test_personal_data_is_replaced(stages):
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"]}
    assert any("@" in t for t in before.values())
    plain = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t)
    assert {r["doc_id"]: r["text"] for r in stages["personal_data"]} == {i: plain(t) for i, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in stages["personal_data"])


def test_sources_come_near_their_targets(stages):
    words = lambda rows: Counter(s for r in rows for s in [r["source"]] * len(r["text"].split()))
    target = brute_targets(dict(words(stages["personal_data"])))
    taken = words(stages["mixing"])
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 90 for s in target)
    assert max(Counter(r["doc_id"] for r in stages["mixing"]).values()) <= 3


def test_all_tokens_are_packed(stages):
    encoder = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in stages["mixing"]:
        ids = [*encoder.encode(r["text"], add_special_tokens=False).ids, 0]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in stages["packing"]) == want
    total = sum(r["length"] for r in stages["packing"])
    assert len({r["sequence_id"] for r in stages["packing"]}) <= -(-total // 2048) + 1


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, stages["sf"]).select("doc_id", "length", "ids_crc32").collect()
    assert sorted(rows) == sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in stages["packing"])


def test_whole_texts_reach_python_in_short_batches(spark, stages, monkeypatch):
    """A stage's lazy result too; a smaller batch of the session wins, and a run puts the session's back."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs, seen = spark.read.parquet(f"{stages['sf']}/documents.parquet"), spark.conf.get(BATCH_ROWS)
    nothing = docs.limit(0)
    most = corpus_pipeline.TEXT_ROWS
    try:
        for own, left in (("10000", most), ("0", most), ("100", 100)):
            for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates):
                spark.conf.set(BATCH_ROWS, own)
                stage(spark, nothing, stages["sf"])
                table = spark.range(2000).coalesce(1).mapInArrow(sizes, "n bigint")
                assert table.agg({"n": "max"}).first()[0] == left
        monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("last", lambda spark, docs, sf_dir: docs)])
        spark.conf.set(BATCH_ROWS, "10000")
        assert corpus_pipeline.run(spark, stages["sf"]).count() == len(stages["toxicity"])
        assert spark.conf.get(BATCH_ROWS) == "10000"
    finally:
        spark.conf.set(BATCH_ROWS, seen)


@pytest.fixture(scope="module")
def no_labels(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("unlabelled"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_odd_rows_go_through_every_stage(spark, odd_docs, no_labels):
    """Nulls, blank and very long texts, repeated rows, and columns named like those used inside."""
    for c in ("held_out", "predicted", "target", "source_size", "class_id", "value", "aside_0", "n_chars"):
        odd_docs = odd_docs.withColumn(c, odd_docs["size"].cast("string"))
    docs, counts = odd_docs, []
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, no_labels), f"odd-{name}")
        counts.append(made.count())
        if name != "packing":
            assert made.columns == odd_docs.columns
            docs = made
    # Nothing is toxic; of the three equal texts one stays.
    assert counts[:3] == [9, 7, 7]
    kept = {r["doc_id"]: r for r in docs.collect()}
    if None in kept:
        assert kept[None]["text"].startswith("mail [EMAIL] or [PHONE] from [IP]")
    assert all(r["predicted"] == (None if r["size"] is None else str(r["size"])) for r in kept.values())
    assert counts[4] >= counts[3]


def test_an_empty_table_goes_through_every_stage(spark, no_docs, no_labels):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, no_labels), f"empty-{name}")
        assert docs.count() == 0
        if name != "packing":
            assert docs.columns == no_docs.columns
