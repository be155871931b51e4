"""Next-day targets, regressions, correlations and the question bank against plain Python."""

from datetime import date, timedelta

import numpy as np
import pytest

from rotativa.operators import market, questions
from rotativa.operators.questions import Question

START = date(2025, 1, 1)


def day(n):
    return START + timedelta(days=n)


def test_next_traded(spark):
    days = spark.createDataFrame([(day(i), i, "x") for i in (0, 1, 2, 3, 6)], "fecha date, n int, _price string")
    prices = spark.createDataFrame([(day(1), 10.0), (day(3), 0.0), (day(5), 12.0), (day(4), None)], "fecha date, cierre double")
    rows = {(r["fecha"] - START).days: (r["cierre_previo"], r["cierre_siguiente"], r["retorno"], r["n"], r["_price"]) for r in market.next_traded(days, prices).collect()}
    assert rows == {
        0: (None, 10.0, None, 0, "x"), 1: (10.0, 0.0, -1.0, 1, "x"), 2: (10.0, 0.0, -1.0, 2, "x"),
        3: (0.0, 12.0, None, 3, "x"), 6: (12.0, None, None, 6, "x"),
    }
    assert {r["cierre_siguiente"] for r in market.next_traded(days, prices.limit(0)).collect()} == {None}
    assert market.next_traded(days.limit(0), prices).count() == 0


def test_folds_learn_from_the_past_only(spark):
    df = spark.createDataFrame([(day(i), i) for i in range(20)], "fecha date, n int")
    rows = market.time_folds(df, 4).collect()
    for fold in range(1, 5):
        learnt = [r["n"] for r in rows if r["fold"] == fold and r["parte"] == "aprende"]
        tested = [r["n"] for r in rows if r["fold"] == fold and r["parte"] == "prueba"]
        assert learnt == list(range(4 * fold)) and tested == list(range(4 * fold, 4 * fold + 4))


@pytest.mark.parametrize("penalty", [0.0, 2.5])
def test_ridge_matches_numpy(spark, penalty):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 3)) * [1, 50, 0.01] + [1e6, 3, 0]
    y = x @ [2.0, -0.5, 30] + r.standard_normal(300) + 7
    group = np.arange(300) % 2
    rows = [(int(g), *map(float, v), float(t)) for g, v, t in zip(group, x, y, strict=True)] + [(0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y double")
    got = {(r["g"], r["term"]): r["coefficient"] for r in market.ridge(df, ["a", "b", "c"], "y", penalty, ["g"]).collect()}
    for g in (0, 1):
        xs, ys = x[group == g], y[group == g]
        centred = xs - xs.mean(axis=0)
        want = np.linalg.solve(centred.T @ centred + penalty * np.eye(3), centred.T @ (ys - ys.mean()))
        assert [got[g, c] for c in "abc"] == pytest.approx(want, rel=1e-6)
        assert got[g, "intercept"] == pytest.approx(ys.mean() - xs.mean(axis=0) @ want, rel=1e-6)


def test_ridge_without_rows_or_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.0)], "a double, b double, y double")
    got = {r["term"]: round(r["coefficient"], 9) for r in market.ridge(df, ["a", "b"], "y").collect()}
    assert got == {"a": 2.0, "b": 0.0, "intercept": 0.0}
    assert market.ridge(df.limit(0), ["a", "b"], "y").count() == 0


def test_fold_errors(spark):
    df = spark.createDataFrame([(day(i), float(i), 3.0 * i + 1) for i in range(16)], "fecha date, a double, y double")
    rows = sorted(market.fold_errors(market.time_folds(df, 3), ["a"], "y").collect())
    assert [(r["fold"], r["n_aprende"], r["n_prueba"]) for r in rows] == [(1, 4, 4), (2, 8, 4), (3, 12, 4)]
    assert all(r["error"] < 1e-9 for r in rows)
    base = [np.sqrt(np.mean((3 * np.arange(n, n + 4) + 1 - np.mean(3 * np.arange(n) + 1)) ** 2)) for n in (4, 8, 12)]
    assert [r["error_base"] for r in rows] == pytest.approx(base)


def test_lagged_correlations(spark):
    r = np.random.default_rng(1)
    a, b = r.standard_normal(40), r.standard_normal(40)
    b[3:] += 2 * a[:-3]
    rows = [(day(i), float(a[i]), float(b[i]), 1.0, None if i == 5 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "fecha date, a double, b double, flat double, gap double")
    got = {(r["a"], r["b"], r["lag"]): (r["n"], r["corr"]) for r in market.lagged_correlations(df, ["a", "gap"], ["b", "flat"], lags=[0, 3]).collect()}
    assert got["a", "b", 0] == (40, pytest.approx(np.corrcoef(a, b)[0, 1]))
    assert got["a", "b", 3] == (37, pytest.approx(np.corrcoef(a[:-3], b[3:])[0, 1])) and got["a", "b", 3][1] > 0.7
    assert got["gap", "b", 0][0] == 39 and got["a", "flat", 3] == (37, None)
    assert len(got) == 8


BANK = [
    Question("trend", "choice", "{titulo}?", ("Up", "Down")),
    Question("chance", "number", "{fecha}", low=0, high=100),
    Question("sector", "impact", "", high=3),
    Question("abroad", "flag"),
]


def test_prompts(spark):
    df = spark.createDataFrame([("t", None)], "titulo string, fecha string").withColumn("questions", __import__("pyspark").sql.functions.lit(1))
    row = questions.with_questions(df, BANK, {"titulo": "titulo", "fecha": "fecha"}).first()
    assert [(q["id"], q["prompt"]) for q in row["questions"]] == [
        ("trend", "t? [Up | Down]"), ("chance", "unknown [0.0 .. 100.0]"), ("sector", " [+/- 0.0 .. 3.0]"), ("abroad", " [si | no]"),
    ]


@pytest.mark.parametrize(
    "response, want",
    [
        ('{"trend": " up ", "chance": 55, "sector": "+2", "abroad": "Sí"}', {"trend": (None, "Up", None), "chance": (55.0, None, None), "sector": (2.0, "positivo", None), "abroad": (1.0, None, None)}),
        ('{"trend": "side", "chance": "101", "sector": "-4", "abroad": "no"}', {"trend": (None, None, "type"), "chance": (None, None, "range"), "sector": (None, None, "range"), "abroad": (0.0, None, None)}),
        ('{"trend": null, "chance": "", "sector": "0", "other": 1}', {"trend": (None, None, "missing"), "chance": (None, None, "missing"), "sector": (0.0, "neutro", None), "abroad": (None, None, "missing")}),
        ('{"trend": "DOWN", "chance": "NaN", "sector": "-0.5", "abroad": "perhaps"}', {"trend": (None, "Down", None), "chance": (None, None, "type"), "sector": (-0.5, "negativo", None), "abroad": (None, None, "type")}),
        ("no json", {q.id: (None, None, "unreadable") for q in BANK}),
        (None, {q.id: (None, None, "unreadable") for q in BANK}),
    ],
)
def test_checked_answers(spark, response, want):
    df = spark.createDataFrame([(1, response, "x")], "k int, response string, question string")
    rows = questions.checked_answers(df, BANK, ["k"]).collect()
    assert {r["question"]: (r["value"], r["label"], r["violation"]) for r in rows} == want


def test_summary(spark):
    rows = [("a", '{"trend": "up", "chance": 10}'), ("a", '{"trend": "up", "chance": 30}'), ("a", None), ("b", '{"trend": "down"}')]
    df = spark.createDataFrame(rows, "day string, response string")
    found = questions.answer_summary(questions.checked_answers(df, BANK[:2], ["day"]), ["day"])
    got = {(r["day"], r["question"]): (r["n"], r["valid"], r["avg_value"], r["labels"]) for r in found.collect()}
    assert got == {("a", "trend"): (3, 2, None, {"Up": 2}), ("a", "chance"): (3, 2, 20.0, {}), ("b", "trend"): (1, 1, None, {"Down": 1}), ("b", "chance"): (1, 0, None, {})}


def test_banks_are_checked(spark):
    with pytest.raises(ValueError):
        Question("x", "choice")
    with pytest.raises(ValueError):
        Question("x", "essay")
    with pytest.raises(ValueError):
        questions.bank_column([BANK[0], BANK[0]])
