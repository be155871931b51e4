import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rotativa.llm import repetition
from rotativa.llm.registry import op6_repetition_rules


def brute(words, window=5, least=8):
    def marked(k):
        places = {}
        for i in range(len(words) - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append(i)
        return {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + k)}

    def repeats(k):
        return len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)}) < len(words) - k + 1

    longest = max((k for k in range(1, len(words)) if repeats(k)), default=0)
    return len(marked(window)), len(marked(least)), longest


def brute_maximal(words, least):
    found = {}
    for k in range(least, len(words)):
        for i in range(len(words) - k + 1):
            found.setdefault(tuple(words[i : i + k]), []).append(i)
    out = []
    for part, at in found.items():
        after = {words[i + len(part)] if i + len(part) < len(words) else None for i in at}
        before = {words[i - 1] if i else None for i in at}
        if len(at) > 1 and (len(after) > 1 or None in after) and (len(before) > 1 or None in before):
            out.append((len(part), at))
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=50), min_size=1, max_size=5))
def test_figures_match_brute_force(texts):
    texts = [t + t[: len(t) // 2] for t in texts]
    assert repetition.Measure(5, 8)(texts) == [brute(t) for t in texts]


def test_maximal_repeats_match_brute_force():
    r = random.Random(6)
    for _ in range(60):
        words = [r.choice("ab") for _ in range(r.randint(0, 30))]
        assert sorted(repetition.maximal_repeats(words, 2)) == sorted(brute_maximal(words, 2))


def test_base_figures(spark):
    text = "x# $y\nsame line\n\nsame line\n \nsame line \n<é>|\tz"
    row = repetition.measure_repetition(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    words = text.split()
    assert (row["n_words"], row["word_chars"]) == (len(words), sum(map(len, words)))
    assert (row["n_symbols"], row["n_dup_lines"]) == (5, 1)


def test_odd_rows(odd_docs):
    rows = {r["doc_id"]: r for r in repetition.measure_repetition(odd_docs).collect()}
    assert rows[3]["n_words"] == rows[4]["n_words"] == rows[5]["n_words"] == 0
    assert rows[6]["longest_repeat"] == 19_999 and rows[6]["n_span_words"] == 20_000
    assert repetition.measure_repetition(odd_docs).count() == 9


def test_query_over_the_table(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b"), (3, "a b c d e f " * 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op6_repetition_rules(spark, str(tmp_path)).collect()}
    assert found == {1: (False, True), 2: (True, False), 3: (True, False)}


def test_empty(no_docs):
    assert repetition.measure_repetition(no_docs).count() == 0


def test_long_periodic_texts_take_linear_time():
    """Every suffix shares nearly all of its words with the next, and intervals lie within intervals."""
    for period in (1, 9):
        words = [b"w%d" % (i % period) for i in range(60_000)]
        assert repetition.Measure(5, 8)([words]) == [(60_000, 60_000, 60_000 - period)]


def test_intervals_that_reach_to_the_left_add_no_words():
    words = "x a b c d e f g h i q a b c d e f g h i z x a b c d e f g h i".split()
    found = repetition.maximal_repeats(words, 8)
    assert sorted(found) == [(9, [1, 11, 22]), (10, [0, 21])]
    assert repetition.Measure(5, 8)([[w.encode() for w in words]]) == [brute(words)]
