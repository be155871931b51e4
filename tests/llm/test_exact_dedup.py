import hashlib
import re
from collections import defaultdict

from rotativa.llm import exact_dedup as e
from rotativa.session import shared_dir


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    """(doc_id, text) pairs to sorted (doc_id, keep_id, group_size, digest)."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append(doc)
    last = lambda d: (d is None, d or 0)
    out = [(doc, min(groups[normal(t)], key=last), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for doc, t in rows]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in df.collect()), key=str)


def test_groups_by_plain_python(spark, odd_docs):
    rows = [(i, f"text  {i % 7}\n{'x' * (i % 3)}") for i in range(300)] + [(1000 + i, "a third of all") for i in range(150)]
    rows += [(5000, "a b"), (5001, "a b"), (5002, "a \t b"), (5003, " a b"), (5004, "a b ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for batches in (1, 2, 5):
        assert found(e.exact_groups(docs, batches=batches)) == brute(rows)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = e.exact_groups(odd_docs)
    assert found(got) == brute(odd)
    kept = [bytes(r["digest"]).hex() for r in got.collect() if r["kept"]]
    assert len(kept) == len(set(kept)) == len({normal(t) for _, t in odd})


def test_only_null_ids_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, None)], "doc_id bigint, text string")
    got = e.exact_groups(docs)
    assert found(got) == brute([(None, "a"), (None, "a"), (None, None)])
    assert got.filter("kept").count() == 2
    assert e.exact_groups(no_docs).count() == 0


def test_index_lives_on(spark, odd_docs):
    path = shared_dir(spark, "digest-test")
    index = e.DigestIndex(spark, path, buckets=3)
    first = e.add(index, odd_docs)
    assert first.columns == odd_docs.columns
    texts = {normal(r["text"]) for r in odd_docs.collect()}
    assert sorted(normal(r["text"]) for r in first.collect()) == sorted(texts)
    # The same batch again adds nothing, also through another name for the table.
    again = e.DigestIndex(spark, path, buckets=99)
    assert again.buckets == 3 and e.add(again, odd_docs).count() == 0
    more = spark.createDataFrame([(1, "short "), (2, "short"), (0, "new"), (3, "new")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["text"]) for r in e.add(again, more).collect()) == [(0, "new"), (1, "short ")]
    before = sorted(map(str, again.entries().collect()))
    again.compact()
    assert sorted(map(str, again.entries().collect())) == before
    later = e.DigestIndex(spark, path)
    assert later.folder == "entries-1" and later.entries().count() == len(before)
    assert e.add(later, more).count() == 0
    later.compact()
    assert e.DigestIndex(spark, path).folder == "entries-2"


def test_index_side_is_not_shuffled(spark, odd_docs):
    index = e.DigestIndex(spark, shared_dir(spark, "digest-test"), buckets=4)
    rows = e.digests(odd_docs)
    e.learn(index, rows)
    plan = index.unseen(e.first_rows(rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("Exchange hashpartitioning") == 1
