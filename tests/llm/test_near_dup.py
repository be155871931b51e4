import random
from collections import defaultdict

import numpy as np
import pytest

from rotativa.llm import near_dup


def jaccard(a, b, width=5):
    def cut(t):
        w = t.encode().split()
        k = min(width, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def brute_classes(texts, similarity=0.8):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if texts[a].split() and jaccard(texts[a], texts[b]) >= similarity:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def varied():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    texts, base = {}, [[word() for _ in range(r.randint(30, 90))] for _ in range(12)]
    passage = [word() for _ in range(15)]
    for i in range(150):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            words[r.randrange(len(words))] = word()
        if i % 10 == 0:
            words = passage + [word() for _ in range(40)]
        texts[i] = " ".join(words)
    return texts


def test_agreement_is_the_weighted_similarity():
    r = np.random.default_rng(1)
    elements = r.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = r.uniform(0.1, 3, 60), r.uniform(0.1, 3, 60)
    s = near_dup.dart_signatures([(elements, a), (elements, b)], 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signature_does_not_depend_on_neighbours():
    sets = [(near_dup.shingles(f"a b c d e f g {i}"), np.ones(4)) for i in range(5)]
    together = near_dup.dart_signatures(sets, 64)
    assert all((near_dup.dart_signatures([s], 64)[0] == t).all() for s, t in zip(sets, together, strict=True))


def test_classes_match_brute_force(spark, varied):
    docs = spark.createDataFrame([(i, t) for i, t in varied.items()], "doc_id bigint, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert found == brute_classes(varied)


def test_small_blocks_lose_no_class(spark, varied, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 3)
    docs = spark.createDataFrame([(i, t) for i, t in varied.items()], "doc_id bigint, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert found == brute_classes(varied)


def test_every_two_rows_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 2)
    named = spark.createDataFrame([(1, f"n{i}") for i in range(9)], "key int, node string")
    groups = defaultdict(list)
    for r in near_dup.in_blocks(named).collect():
        groups[(r["i"], r["j"])].append((r["block"], r["node"]))
    met = [
        frozenset((a[1], b[1])) for (i, j), rows in groups.items() for n, a in enumerate(rows) for b in rows[:n] if i == j or a[0] != b[0]
    ]
    assert len(met) == len(set(met)) == 36


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y")], "a string, b string")
    labels = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    assert labels == {**{f"{i:03}": "000" for i in range(41)}, "x": "x", "y": "x"}


def test_few_links_make_few_files(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FILE_LINKS", 10)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = near_dup.components(spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(0, 20, 2)], "a string, b string"))
        assert len(labels.inputFiles()) <= 20 // 10 + 1
        assert labels.count() == 20
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_odd_rows(odd_docs):
    found = defaultdict(list)
    for r in near_dup.near_duplicates(odd_docs).collect():
        found[r["doc_id"]].append(r["class_id"])
    assert found == {1: [1, 1], 2: [1], None: [None], 3: [3], 4: [4], 5: [5], 6: [6], 7: [7]}
    kept = near_dup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "4", "5", "6", "7", "None"]


def test_empty(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.keep_first(no_docs).count() == 0
