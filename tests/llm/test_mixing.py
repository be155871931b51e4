import random

from rotativa.llm import mixing
from rotativa.llm.common import numbered


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in capped and target[s] >= most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets(spark):
    r = random.Random(4)
    for _ in range(4):
        sizes = {f"s{i}": r.choice([10, 50, 400, 10_000]) for i in range(r.randint(1, 9))} | {None: 30}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {x["source"]: x["target"] for x in mixing.source_targets(frame).collect()}
        want = brute_targets(sizes)
        assert found.keys() == want.keys()
        assert all(abs(found[s] - want[s]) < 1e-6 for s in want)


def test_words_come_near_their_target(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 40), r.choice("aaaabcd")) for i in range(1500)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()
    assert sorted(mixed) == sorted(again)
    taken = {}
    for m in mixed:
        taken.setdefault((m["source"], m["target"]), []).append(m["size"] * m["copies"])
        assert 0 <= m["copies"] <= 3
    assert all(abs(sum(v) - target) <= 60 for (_, target), v in taken.items())
    copies = mixing.repeated(mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")))
    assert copies.count() == sum(m["copies"] for m in mixed)


def test_numbers_within_a_hot_group(spark):
    rows = [("h" if i % 3 else None, i % 2, (i * 37 % 1000) / 1000, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, s int, place double, id int")
    found = numbered(frame, ["g"], ["s"], "place", ("id",)).collect()
    for g in ("h", None):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["_index"])
        assert [r["_index"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["s"], r["place"], r["id"]))


def test_odd_rows(odd_docs):
    mixed = mixing.mix(odd_docs)
    rows = mixed.collect()
    assert len(rows) == 9
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    assert all(r["target"] == 0 and r["copies"] == 0 for r in rows if r["source"] == "b")
    assert set(mixing.repeated(mixed).columns) == set(odd_docs.columns) - {"size", "copies"}


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0
