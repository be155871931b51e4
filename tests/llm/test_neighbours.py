import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.llm import neighbours


def frame(spark, vectors, **more):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({k: F.lit(v) for k, v in more.items()})


def found(df, **kw):
    out = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, **kw).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def brute(vectors, k):
    ids, rows = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, rows, strict=True):
        if i % 20 == 0:
            score = (rows * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_recall(spark):
    r = np.random.default_rng(1)
    vectors = [(i, v / np.linalg.norm(v)) for i, v in enumerate(r.standard_normal((2500, 32)))]
    got, want = found(frame(spark, vectors)), brute(vectors, 20)
    hits = [len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = found(frame(spark, vectors), probe_share=1.0)
    assert {q: [v for _, v, _ in rows] for q, rows in exact.items()} == want


@pytest.mark.parametrize("sigma", [0.25, 0.5, 1.0, 2.0])
def test_recall_with_unequal_lengths(spark, sigma):
    r = np.random.default_rng(5)
    lengths = np.exp(sigma * r.standard_normal(2500))
    vectors = [(i, n * v / np.linalg.norm(v)) for i, (v, n) in enumerate(zip(r.standard_normal((2500, 32)), lengths, strict=True))]
    got, want = found(frame(spark, vectors)), brute(vectors, 20)
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_cells_come_in_the_order_of_summed_distance():
    r = np.random.default_rng(2)
    a, b, rows = r.random(6), r.random(6), r.integers(0, 3, 36)
    cells = neighbours.nearest_cells(a, b, rows, 1e9)
    want = [c for _, c in heapq.nsmallest(36, [(a[c // 6] + b[c % 6], c) for c in range(36)]) if rows[c]]
    assert cells == want


def test_crowded_cells_are_split():
    first, parts = neighbours.pack_cells({0: 5, 1: 25, 2: 4, 3: 7, 4: 10}, 10)
    blocks = {c: list(range(first[c], first[c] + parts[c])) for c in first}
    assert len(blocks[1]) == 3
    assert not set(blocks[1]) & {b for c in (0, 2, 3, 4) for b in blocks[c]}
    load = {}
    for c, n in {0: 5, 2: 4, 3: 7, 4: 10}.items():
        load[blocks[c][0]] = load.get(blocks[c][0], 0) + n
    assert max(load.values()) <= 10


def test_many_copies_tie_to_the_smaller_id(spark):
    r = np.random.default_rng(3)
    one = r.standard_normal(16)
    vectors = [(i, one if i % 2 == 0 else v) for i, v in enumerate(r.standard_normal((300, 16)))]
    got = found(frame(spark, vectors), k=5)
    assert [v for _, v, _ in got[20]] == [0, 2, 4, 6, 8]
    assert len({s for _, _, s in got[20]}) == 1


def test_odd_vectors(spark):
    bad = [(20, None), (40, [0, 0]), (60, [1, None]), (1, [float("nan"), 1]), (2, [float("inf"), 1]), (3, [1, 2, 3]), (None, [1, 1])]
    good = [(0, [1, 0]), (4, [1, 1]), (5, [2, 0]), (5, [2, 0]), (80, [-1, 0])]
    got = found(frame(spark, bad + good, rank=1, cell="x", vector=2, block=0))
    assert {q: [(n, v) for n, v, _ in rows] for q, rows in got.items()} == {0: [(1, 5), (2, 4), (3, 80)], 80: [(1, 0), (2, 4), (3, 5)]}


def test_empty(spark):
    assert neighbours.search(frame(spark, []), F.lit(True)).count() == 0
    assert neighbours.search(frame(spark, [(20, [0, 0])]), F.lit(True)).count() == 0
