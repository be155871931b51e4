import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rotativa.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEIRD = [
    "a@b.c_d@e.f x@y.z.@q.r aa+b@c-d.e-f..g @x.y a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3.4444 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111 x4111-1111-1111-1111y 4111 1111 1111 1112 41111111111111112222",
    "+1 (988) 555-2485 or +12 3 +1 23.45-6789 + 12345678901 +1", "éé ü 😀 a@b.cd 😀 +1 234 567 8901.", "+" * 50 + "1" * 30,
    "a" * 5000 + "@" + "b." * 3000 + "c", "9" * 20_000, "1 " * 8000, "a@b.c" * 50, None, "",
]


def luhn(d):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute(text):
    spans = []
    for kind, form in PLAIN.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda d, v: True,
                "ip": lambda d, v: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda d, v: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d, v: 9 <= len(d) <= 15,
            }[kind](d, m[0])
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)


def base(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = pii.with_base(frame).select("row.doc_id", pii.in_words(F.col("_base")).alias("s")).collect()
    return [r["s"] for r in sorted(spans)]


def test_base_spans_match_the_plain_forms(spark):
    assert base(spark, WEIRD) == [brute(t) for t in WEIRD]


def test_base_spans_of_any_text(spark):
    texts = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet="a@.1+- ()_9éx42", max_size=40))
    def collect(text):
        texts.append(text)

    collect()
    assert base(spark, texts) == [brute(t) for t in texts]


def bootstrapped():
    """Customer ids in a form of their own behind words that otherwise lead to phones."""
    rows = [f"please call phone: +1 (555) {200 + i}-{1000 + i} today" for i in range(60)]
    rows += [f"please call phone: 0800-{77000 + i} today" for i in range(4)]
    rows += ["total 0800-77001 pieces", "order 1234567 of the day", "the 98765 the 12345"]
    return rows


def test_contexts_discover_unseen_identifiers(spark):
    texts = bootstrapped()
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    value = lambda i: [texts[i][s["start"] : s["stop"]] for s in found[i]["spans"]]
    assert [value(i) for i in range(60, 64)] == [[f"0800-{77000 + i}"] for i in range(4)]
    assert value(64) == ["0800-77001"]
    assert value(65) == value(66) == []
    assert all(found[i]["n_phone"] == 0 and found[i]["base_spans"] == [] for i in range(60, 67))
    assert {pii.KINDS[s["rank"]] for i in range(60, 65) for s in found[i]["spans"]} == {"phone"}


def test_mostly_unseen_contexts_and_long_chains(spark):
    ids = lambda k: [f"{k}{n}-{70000 + n}" for n in range(8)]
    texts = [f"please call phone: +1 (555) {200 + i}-{1000 + i} today" for i in range(9)]
    texts += [f"please call phone: 0800-{77000 + i} today" for i in range(120)]
    # Each form stands behind the words of the one before it and behind words of its own.
    before = ["call phone:"] + [f"chain{k} link{k}:" for k in range(5)]
    texts += [f"{before[k]} {v} here" for k in range(5) for v in ids(k)]
    texts += [f"{before[k + 1]} {v} here" for k in range(5) for v in ids(k)]
    # A context of two kinds is evidence for neither.
    texts += [f"my contact +1 (555) {300 + i}-{2000 + i} x" for i in range(6)] + [f"my contact a{i}@b.cd x" for i in range(6)]
    texts += ["my contact 555-66677 x", "order 1234567 of the day"]
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert all(len(found[i]) == 1 for i in range(len(texts) - 2))
    assert found[len(texts) - 2] == found[len(texts) - 1] == []


def test_contexts_are_whole_words(spark):
    long, gap = "w" * 100, " " * 200
    texts = [f"{k} +1 (555) {200 + i}-{1000 + i} today" for i in range(9) for k in (f"call {long}:", f"table{gap}cell:{gap}", "dial it:")]
    texts += [f"{long} now tel:+1 (555) {300 + i}-{1000 + i} x" for i in range(9)]
    unseen = [(f"call {long}:", "0341-55512"), (f"table{gap}cell:{gap}", "0342-55512"), ("dial it:", "0341 555 1234"), ("dial it: \"", "0344 \t555 1299")]
    rows = texts + [f"{left}{value}, today" if left.endswith('"') else f"{left} {value}, today" for left, value in unseen] + ["order 12 345 67 of"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    found = {r["doc_id"]: [rows[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in pii.find_pii(docs).collect()}
    assert [found[len(texts) + i] for i in range(5)] == [[v] for _, v in unseen] + [[]]
    seen = pii.occurrences(pii.with_base(docs)).filter("glued").collect()
    assert {(r["last"], r["first"]) for r in seen} == {("tel:", "now")} and len(seen) == 9


def test_rare_contexts_count_in_any_corpus(spark):
    edges = [(0, f"word{i % 700}", f"{i}@b.c", 1.0) for i in range(700 * 90)] + [(3, "call", f"+1 555 000 00{i}", 1.0) for i in range(5)]
    frame = spark.createDataFrame(edges + [(3, "rare", f"+1 555 000 00{i}", 1.0) for i in range(4)], "rank int, pattern string, value string, score double")
    found = {(r["rank"], r["pattern"]) for r in pii.candidate_patterns(frame).collect()}
    assert (3, "call") in found and (3, "rare") not in found and len(found) == 701


def test_pattern_frequency(spark):
    docs = spark.createDataFrame([("a b a\tb",), ("b",), (None,), (" A  c ",)], "text string")
    wanted = spark.createDataFrame([("a",), ("b",), ("a b",), ("b a",), ("b b",), ("c",)], "pattern string")
    counts = {r["pattern"]: r["n"] for r in pii.pattern_frequency(docs, wanted).collect()}
    assert counts == {"a": 3, "b": 3, "a b": 2, "b a": 1, "c": 1}


def test_redaction(spark):
    texts = ["mail a@b.cd or 😀 +1 234 567 8901.", "nothing", None, "x 10.0.0.1@b.c y"]
    out = pii.redact(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()
    assert [r["text"] for r in sorted(out, key=lambda r: r["doc_id"])] == ["mail [EMAIL] or 😀 [PHONE].", "nothing", None, "x [EMAIL] y"]


def test_odd_rows(odd_docs):
    found = pii.find_pii(odd_docs)
    rows = found.collect()
    assert len(rows) == 9
    assert set(odd_docs.columns) <= set(found.columns)
    only = next(r for r in rows if r["doc_id"] is None)
    assert (only["n_email"], only["n_ip"], only["n_card"], only["n_phone"]) == (1, 1, 0, 1)


def test_empty(no_docs):
    assert pii.find_pii(no_docs).count() == 0


def test_digest(spark):
    frame = spark.createDataFrame([(1, "10.0.0.1 a@b.c")], "doc_id bigint, text string")
    row = pii.find_pii(frame).select(F.sha2(pii.in_words(F.col("base_spans")), 256).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"email:9:14,ip:0:8").hexdigest()
