import numpy as np
import pytest

from rotativa.operators import topics


def brute(cells, k, rounds):
    """The same updates on a dense matrix; names of rows and columns, factors and errors."""
    from hashlib import md5

    rows, cols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    v = np.zeros((len(rows), len(cols)))
    for r, c, x in cells:
        v[rows.index(r), cols.index(c)] = x
    start = lambda names: np.array([[int(md5(f"{i}:{n}".encode()).hexdigest()[:8], 16) / 2**32 + 0.5 for i in range(k)] for n in names])
    w, h, errors = start(rows), start(cols), []
    for _ in range(rounds):
        h = h * (v.T @ w) / (h @ (w.T @ w))
        w = w * (v @ h) / (w @ (h.T @ h))
        errors.append(((v - w @ h.T) ** 2).sum())
    return rows, cols, w, h, errors


CELLS = [(f"d{i}", f"w{j}", float(1 + (i * j) % 4 + 5 * (i % 2 == j % 2))) for i in range(12) for j in range(15) if (i + j) % 3]


def test_factors_match_numpy(spark):
    df = spark.createDataFrame(CELLS, "row string, col string, x double")
    found = topics.factorise(df, 2, rounds=6)
    rows, cols, w, h, errors = brute(CELLS, 2, 6)
    assert found.errors == pytest.approx(errors)
    assert all(a >= b - 1e-9 for a, b in zip(found.errors, found.errors[1:], strict=False))
    got = {r["row"]: (r["t0"], r["t1"]) for r in found.rows.collect()}
    assert [got[r] for r in rows] == [pytest.approx(tuple(x)) for x in w]
    got = {r["col"]: (r["t0"], r["t1"]) for r in found.cols.collect()}
    assert [got[c] for c in cols] == [pytest.approx(tuple(x)) for x in h]
    top = [(r["topic"], r["rank"], r["term"]) for r in topics.topic_terms(found, 3).orderBy("topic", "rank").collect()]
    want = [(t, n + 1, cols[i]) for t in range(2) for n, i in enumerate(np.argsort(-h[:, t], kind="stable")[:3])]
    assert top == want
    shares = {}
    for r in topics.topic_shares(found).collect():
        shares.setdefault(r["row"], []).append(r["share"])
    assert all(sum(s) == pytest.approx(1) for s in shares.values()) and len(shares) == len(rows)


def test_rounds_stop_when_little_is_gained(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "row string, col string, x double")
    found = topics.factorise(df, 1, rounds=30, tolerance=0.01)
    assert len(found.errors) < 5 and found.errors[-1] < 1e-9


def test_cells_and_empty(spark):
    df = spark.createDataFrame([("2025-01-01", "Sol y sol, lluvia"), ("2025-01-01", None), (None, "sol"), ("2025-01-02", "")], "fecha string, texto string")
    cells = topics.term_cells(df, "fecha", "texto")
    assert {tuple(r) for r in cells.collect()} == {("2025-01-01", "sol", 2.0), ("2025-01-01", "y", 1.0), ("2025-01-01", "lluvia", 1.0)}
    nothing = topics.factorise(cells.limit(0), 2, rounds=2)
    assert nothing.errors == [0.0, 0.0] and topics.topic_terms(nothing).count() == 0 and topics.topic_shares(nothing).count() == 0
