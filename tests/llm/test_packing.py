import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rotativa import session
from rotativa.llm import packing

ODD_TEXTS = [
    "İstanbul ß ŉ ẞ Σας ΣΑΣ ab's don't I'LL <|endoftext|> x<|endoftext|>y a... 1234, é́ \xa0 é ﬁ Ǆ 'tis s't ’s ①② foo'. bar,' ‑-, x_y_z (a) [b]",
    "", " ", "\x1c\x85 a\u2003b", "日本語 текст العربية", "a" * 3000, "!!! ... ,,,", "UPPER Case ÉÀ",
]


def test_ids_are_the_tokenizers():
    words = packing.WordIds(packing.tokenizer_path())
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for text in ODD_TEXTS:
        assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_words_that_come_again_outlive_a_full_cache(monkeypatch):
    """At most two lots are held, ids stay the tokenizer's, and a word in use is encoded once."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    words, whole, made = packing.WordIds(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path()), []
    monkeypatch.setattr(packing.WordIds, "made", lambda self, word, f=packing.WordIds.made: made.append(word) or f(self, word))
    for i in range(300):
        text = f"again Again, n{i} {'x' * (i % 17)}y{i}"
        assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert max(len(words), len(words.before)) <= 43
    assert made.count(b"again") == 1


def test_few_rows_are_in_python_at_once(spark, monkeypatch):
    """The batch size holds for the write alone, and a smaller one of the session wins."""
    seen = spark.conf.get(session.BATCH_ROWS)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        for own, asked, most in (("1000", 8, 8), ("0", 8, 8), ("5", 8, 5), ("1000", 0, 50)):
            spark.conf.set(session.BATCH_ROWS, own)
            table = session.materialize(spark.range(50).coalesce(1).mapInArrow(sizes, "n bigint"), "sizes", asked)
            assert table.agg({"n": "max"}).first()[0] == most and spark.conf.get(session.BATCH_ROWS) == own
        rows = []
        spark.conf.set(session.BATCH_ROWS, "1000")
        monkeypatch.setattr(packing, "materialize", lambda df, label, n=0: rows.append(n) or session.materialize(df, label, n))
        docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
        assert packing.stored_pieces(docs).count() == 20 and rows == [packing.BATCH_ROWS]
    finally:
        spark.conf.set(session.BATCH_ROWS, seen)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    words, whole = _tools()
    text = text.encode("utf-8", "ignore").decode()
    assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _tools(kept=[]):  # noqa: B006
    if not kept:
        kept += [packing.WordIds(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())]
    return kept


def test_every_piece_is_planned_once():
    r = random.Random(1)
    for capacity in (8, 60, 2048):
        for _ in range(20):
            counts = Counter(min(capacity, max(1, int(r.lognormvariate(np.log(capacity) - 1.5, 1)))) for _ in range(r.randint(1, 400)))
            patterns = packing.plan_patterns(counts, capacity)
            used = Counter()
            for lengths, times in patterns:
                assert times > 0 and sum(lengths) <= capacity
                for length in lengths:
                    used[length] += times
            assert used == counts


def test_exact_complements_fill_sequences():
    patterns = packing.plan_patterns({7: 5, 3: 5, 6: 2, 2: 4, 1: 3, 10: 1, 5: 1, 4: 1}, 10)
    assert sum(n for _, n in patterns) == -(-sum(a * b for a, b in {7: 5, 3: 5, 6: 2, 2: 4, 1: 3, 10: 1, 5: 1, 4: 1}.items()) // 10)


def check(docs, rows, capacity):
    whole, seen, sequences = _tools()[1], Counter(), {}
    for r in rows:
        seen[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert seen == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_rows(odd_docs):
    rows = packing.pack(packing.cut_pieces(odd_docs)).collect()
    check([(r["doc_id"], r["text"]) for r in odd_docs.collect()], rows, packing.CAPACITY)


def test_packs_tightly(spark):
    r = random.Random(3)
    docs = [(i, "word " * int(r.lognormvariate(3.5, 1))) for i in range(800)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = packing.pack(packing.cut_pieces(frame, capacity=128), 128).collect()
    assert check(docs, rows, 128) <= -(-sum(x["length"] for x in rows) // 128) * 1.01 + 1


def test_empty(no_docs):
    assert packing.pack(packing.cut_pieces(no_docs)).count() == 0
