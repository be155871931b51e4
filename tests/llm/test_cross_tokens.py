import hashlib
from collections import Counter

import numpy as np
import pytest

from rotativa.llm import cross_tokens as c

TEXTS = [
    "Hello world, it's a test.\nSecond line here; don't stop",
    "a  b   c\td\r\ne  \n\n f g 　 h",
    "  leading and trailing  ",
    "\nline first\n",
    "word\n word\n\nword \nword",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    "naïve façade ßtraße señor Łódź Привет мир 你好世界 🙂👍🏽 é ​﻿",
    "x" * 3000,
    "12345 3.14 1,000 $$$ ### &&& foo$$$ (bar) [baz];\r {\r",
    "has ▁ inside", "a▁", "▁",
    " ", "\n", "\t", "\r", "\x00 nul", "tab\tinside word", "a\x1cb c\x85d",
    "für bertzß. éeuxier, ANNT! andonly?\nthe; end: 'quoted' \"double\"",
    "", None,
]


@pytest.fixture(scope="module")
def paths():
    return c.vocabulary_path("byte_bpe_50k.json"), c.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def words(paths):
    return c.Vocabularies(*paths)


def whole(words, text):
    """Groups of a text encoded in one piece: lists of A ids and of B ids, or None without tokens."""
    if not text:
        return None
    a, b = words.a.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text)
    joined = (" " + text).encode()
    if b"".join(words.bytes_a[i] for i in a) != joined or b"".join(words.bytes_b[i] for i in b) != joined:
        return None
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((words.bytes_a, a), (words.bytes_b, b))]
    groups, begin = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [ends[0].index(end) + 1, ends[1].index(end) + 1]
        groups.append((a[begin[0] : upto[0]], b[begin[1] : upto[1]]))
        begin = upto
    return groups


def brute(words, texts):
    """One result tuple per text."""
    split = [whole(words, t) for t in texts]
    linked = [Counter((a, b) for g in s or [] for a in g[0] for b in g[1]) for s in split]
    counts = Counter(p for x in linked for p in x)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for s, x in zip(split, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in s or [])
        out.append((
            sum(len(a) for a, _ in s or []), sum(len(b) for _, b in s or []), len(s or []), sum(x.values()),
            sum(n for p, n in x.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in x.items()),
            hashlib.sha256(text.encode()).hexdigest() if s else "",
        ))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(df):
    return {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_against_whole_texts(spark, words):
    r = np.random.default_rng(1)
    parts = [p for t in TEXTS if t for p in (t, t[: len(t) // 2])]
    texts = TEXTS + ["".join(r.choice(parts + [" ", "\n", "  ", "\r\n", " the", ",", "'s"], 6)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = brute(words, texts)
    got = found(c.align_tokens(docs))
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i] == row, (i, texts[i])


def test_many_chunks_shards_and_levels(spark, words, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 200)
    monkeypatch.setattr(c, "BATCH_BYTES", 100)
    monkeypatch.setattr(c, "SHARD_PAIRS", 16)
    monkeypatch.setattr(c, "FAN", 3)
    texts = [f"some words {i % 5} again, and {'more ' * (i % 4)}ending{i % 9}\nline" for i in range(90)] + ["copy of a text"] * 45
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = found(c.align_tokens(docs))
    assert [got[i] for i in range(len(texts))] == brute(words, texts)


def test_odd_rows(spark, words, odd_docs, no_docs):
    rows = odd_docs.collect()
    want = brute(words, [r["text"] for r in rows])
    got = [tuple(r[f] for f in ("doc_id", *FIELDS)) for r in c.align_tokens(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(((r["doc_id"], *w) for r, w in zip(rows, want, strict=True)), key=str)
    assert c.align_tokens(no_docs).count() == 0


def test_without_common_cuts(words, paths):
    """Whole texts as units, as for vocabularies that join words."""
    units = c.Units(*paths)
    units.words.cuts = False
    for text in TEXTS:
        flat, counts = units.read([text])
        s = whole(words, text)
        assert units.in_a[flat].sum() == sum(len(a) for a, _ in s or []) and (s is None) == (counts[0] == 0)


def test_large_groups_are_counted_once(words):
    groups = c.Groups(words, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    groups.a, groups.b = np.arange(300) % 7, np.arange(206) % 5
    groups.in_a, groups.in_b, groups.unit = np.array([292, 8]), np.array([204, 2]), np.array([3, 3])
    unit, pairs, times = groups.links()
    assert len(pairs) == 35 + 16 and times.sum() == 292 * 204 + 16 and set(unit) == {3}
    want = Counter((int(a), int(b)) for a in groups.a[:292] for b in groups.b[:204])
    want.update((int(a), int(b)) for a in groups.a[292:] for b in groups.b[204:])
    found = Counter()
    for p, n in zip(pairs.tolist(), times.tolist(), strict=True):
        found[p >> 32, p & 0xFFFFFFFF] += n
    assert found == want


def test_perfect_hash():
    for n in (0, 1, 2, 5000):
        keys = np.random.default_rng(n).choice(10**12, n, replace=False)
        hash_ = c.PerfectHash.build(keys)
        assert sorted(hash_(keys).tolist()) == list(range(n))
    ordered = np.empty_like(keys)
    ordered[hash_(keys)] = keys
    assert (c.places(hash_, ordered, keys[:100]) == hash_(keys[:100])).all()
    with pytest.raises(ValueError):
        c.places(hash_, ordered, np.array([10**13 + 7, *range(10**13, 10**13 + 200)]))


def test_the_cache_may_be_dropped(words, paths, monkeypatch):
    monkeypatch.setattr(c, "KEPT_UNITS", 3)
    units = c.Units(*paths)
    for _ in range(2):
        for text in TEXTS:
            if units.full():
                units.clear()
            flat, counts = units.read([text])
            assert units.in_b[flat].sum() == sum(len(b) for _, b in whole(words, text) or [])
            pairs, number = units.documents_with(flat, counts)
            assert {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs} == {(a, b) for x, y in whole(words, text) or [] for a in x for b in y}
            assert (number == 1).all()
