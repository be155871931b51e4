import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.llm import lm

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.decode() for w in (text or "").translate(UPPER).encode().split()] + [None]


def brute(docs, order, prior):
    """docs: (text, learned). Per text: tokens, known, base score, score."""
    grams = [Counter() for _ in range(order)]
    histories = Counter()
    for text, learned in docs:
        if learned:
            t = [0] * (order - 1) + tokens(text)
            for i in range(order - 1, len(t)):
                for n in range(order):
                    grams[n][tuple(t[i - n : i + 1])] += 1
                    histories[tuple(t[i - n : i])] += 1
    total, types = sum(grams[0].values()), len(grams[0])
    out = []
    for text, _ in docs:
        t, base, score = [0] * (order - 1) + tokens(text), 0.0, 0.0
        for i in range(order - 1, len(t)):
            p = (grams[0][(t[i],)] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(1, order):
                p = (grams[n][tuple(t[i - n : i + 1])] + prior * p) / (histories[tuple(t[i - n : i])] + prior)
            score += math.log10(p)
        known = sum(grams[0][(w,)] > 0 for w in tokens(text))
        out.append((len(t) - order + 1, known, total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(lm, "PART", 4)
    r = random.Random(order)
    texts = [" ".join(r.choice(["A", "b", "C", "dd", "É", f"x{r.randrange(40)}"]) for _ in range(r.randint(0, 15))) for _ in range(60)]
    learned = [i % 4 > 0 for i in range(60)]
    frame = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, learned, strict=True))], "doc_id bigint, text string, b boolean")
    rows = sorted(lm.score_texts(frame, F.col("b"), order).collect())
    assert [r["held_out"] for r in rows] == [not b for b in learned]
    for row, want in zip(rows, brute(list(zip(texts, learned, strict=True)), order, lm.PRIOR), strict=True):
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == want[:3]
        assert (row["base_score"], row["score"]) == pytest.approx(want[3:], abs=1e-9)


def test_weights_out_of_a_state_add_up_to_one():
    texts = ["a b a c", "a b b", "c a"]
    chunk = [lm.token_hashes(t) for t in texts]
    words = sorted({w for t in texts for w in t.split()})
    docs = [(t, True) for t in texts]
    grams = lm.ngrams(chunk)
    assert [len(g) for g in grams] == [12, 12]
    total, types = 12, len(words) + 1
    for history in words:
        after = Counter(b for t in texts for a, b in zip(tokens(t), tokens(t)[1:], strict=False) if a == history)
        count = sum(after.values())
        first = Counter(w for t, _ in docs for w in tokens(t))
        chances = [(after[w] + lm.PRIOR * (first[w] + 1) / (total + types + 1)) / (count + lm.PRIOR) for w in [*words, None, "unseen"]]
        assert sum(chances) == pytest.approx(1)


def automaton(texts, learned, order):
    import pandas as pd

    keys, counts, places, lengths = lm.chunk_ngrams(pd.DataFrame({"text": texts}), np.array(learned), order)
    total, types = int(counts[0].sum()), int((counts[0] > 0).sum())
    return lm.Automaton(keys, counts, places, lengths, total, types, lm.PRIOR)


def test_states_are_the_longest_seen_histories():
    made = automaton(["a b a c", "a b d", "d d q"], [True, True, False], 3)
    assert made.words == 6  # four words of the texts learnt from or not, one only scored, and the end
    # From any state, failure arcs end in the empty history, which has an arc for every word.
    for state in range(len(made.failure)):
        steps = 0
        while state:
            state, steps = made.failure[state], steps + 1
        assert steps < 3
    assert made.arcs[: made.words].tolist() == list(range(made.words))
    # Arcs lead only to histories that were seen.
    assert made.known[made.target].all()


def test_parts_of_a_text_carry_on_where_the_last_ended(monkeypatch):
    r = random.Random(0)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (40, 3, 0, 17)]
    whole = automaton(texts, [True, True, True, False], 3).walk()
    monkeypatch.setattr(lm, "PART", 5)
    assert automaton(texts, [True, True, True, False], 3).walk() == pytest.approx(whole, abs=1e-12)


def test_without_training_texts():
    made = automaton(["a b", ""], [False, False], 2)
    assert made.walk() == pytest.approx(np.log10(np.ones(4)), abs=1e-12)


def test_packed_numbers():
    for values in ([], [0], [255, 256], [1 << 40, 3], [(1 << 64) - 1]):
        array = np.array(values, np.uint64)
        assert lm.unpacked(lm.packed(array)).tolist() == values
        assert lm.unpacked_sorted(lm.packed_sorted(np.sort(array))).tolist() == sorted(values)


def test_odd_rows(odd_docs):
    rows = lm.score_texts(odd_docs, F.col("doc_id") != 7).collect()
    assert len(rows) == 9
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert next(r for r in rows if r["doc_id"] is None)["held_out"]
    want = brute([(r["text"], r["doc_id"] not in (7, None)) for r in odd_docs.collect()], 2, lm.PRIOR)
    assert sorted(r["score"] for r in rows) == pytest.approx(sorted(w[4] for w in want))


def test_empty(no_docs):
    assert lm.score_texts(no_docs, F.lit(True)).count() == 0
