import math
from fractions import Fraction

import numpy as np
import pytest

from rotativa.llm import whitening as w


def exact(vectors):
    """n, sums, exact covariance and deviations of whole-number vectors in plain Python."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    far = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = [[Fraction(sum(f[i] * f[j] for f in far), n**3) for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(c) for c in r] for r in cov]), [sum(c * c for c in f) for f in far], x


@pytest.mark.parametrize("spread", [0.2, 3000.0, 2.0e10])
def test_against_exact_fractions(spark, spread):
    r = np.random.default_rng(3)
    vectors = (r.standard_normal((150, 6)) * spread * [1, 2, 3, 0.5, 1, 1.5]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(3)
    n, s, cov, deviation, x = exact(vectors)
    got_n, got_s, got_cov = w.fit(w.whole_vectors(df))
    assert (got_n, got_s) == (n, s)
    assert np.allclose(got_cov, cov, rtol=1e-14, atol=0)
    rows = w.whiten(df, count=4).collect()
    assert len(rows) == 150 * 4
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = (np.array(x, float) - np.array(s) / n) @ axes / np.sqrt(values)
    scores = np.zeros((150, 4))
    for row in rows:
        scores[row["id"], row["component"] - 1] = row["whitened"]
        assert int(row["deviation"]) == deviation[row["id"]] and row["n"] == n
        assert row["explained"] == pytest.approx(values[row["component"] - 1] / np.trace(cov), rel=1e-9)
        assert row["identity_error"] < 1e-9
    signs = np.sign((scores * want[:, :4]).sum(axis=0))
    assert np.allclose(scores * signs, want[:, :4], atol=1e-7)


def test_odd_vectors(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(good + [good[3]] + bad, "vec_id bigint, embedding array<double>")
    df = df.withColumns({c: df.vec_id for c in ("x", "id", "at", "whitened", "component", "n")})
    rows = w.whiten(df).collect()
    assert sorted({r["id"] for r in rows}) == list(range(20))
    assert len(rows) == 21 * 3 and {r["n"] for r in rows} == {21}
    n, s, cov, deviation, _ = exact([v for _, v in good + [good[3]]])
    assert {(r["id"], int(r["deviation"])) for r in rows} == {(i, deviation[i]) for i, _ in good}
    # The third dimension never varies, so there is no third component to scale.
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in rows)
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_one_vector_and_none(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0])], "vec_id string, embedding array<double>")
    rows = w.whiten(one).collect()
    assert [(r["id"], r["component"], r["whitened"], int(r["deviation"]), r["identity_error"]) for r in rows] == [("a", 1, None, 0, 0.0), ("a", 2, None, 0, 0.0)]
    empty = w.whiten(one.limit(0))
    assert empty.count() == 0 and empty.columns == w.whiten(one).columns


def test_sums_of_pairs():
    for y in (np.array([[1, -2, 3], [4, 5, -6]]), np.array([[2**40, -(2**41)], [2**45, 7]])):
        d = y.shape[1]
        want = [sum(int(r[i]) ** 2 for r in y) for i in range(d)]
        want += [sum((int(r[i]) + int(r[j])) ** 2 for r in y) for i in range(d) for j in range(i + 1, d)]
        assert w.pair_squares(y) == want
