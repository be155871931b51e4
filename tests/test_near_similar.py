"""Near and similar articles, languages and components against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.operators import languages, near, similar, terms
from rotativa.operators.graph import components


def weights_of(texts):
    """Unit tf-idf vectors of texts by term."""
    counts = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    often = Counter(w for c in counts for w in c)
    out = []
    for c in counts:
        v = {w: (1 + math.log(n)) * (1 + math.log((1 + len(texts)) / (1 + often[w]))) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()})
    return out


def classes_of(rows, least):
    """(key, smallest key of the class) from (key, text) pairs, by comparing all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    vectors = dict(zip(texts, weights_of(texts + ([""] if any(t is None for _, t in rows) and "" not in texts else [])), strict=False))
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if vectors[a] and vectors[b] and sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) >= least:
                parent[root(a)] = root(b)
    first = {}
    for key, t in sorted(rows):
        if t and vectors[t]:
            first.setdefault(root(t), key)
    return {key: first[root(t)] if t and vectors[t] else key for key, t in rows}


@pytest.fixture(scope="module")
def written():
    """Texts with copies, near copies in chains, and a passage that many share."""
    r = random.Random(2)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 900}"
    base = [[word() for _ in range(r.randint(15, 60))] for _ in range(14)]
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(160):
        words = list(r.choice(base)) if i % 3 else [word() for _ in range(30)]
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words + (passage if i % 9 == 0 else []))))
    rows += [(200 + i, "a third of all rows is this") for i in range(80)]
    return rows + [(300, None), (301, ""), (302, " .,\n"), (303, "word"), (304, "Word!"), (305, "lorem " * 5000), (306, "¿Qué? 東京 x_1")]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.95])
def test_near_articles_match_all_pairs(spark, written, least, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    df = spark.createDataFrame(written, "k bigint, text string").withColumns({c: F.lit("x") for c in ("node", "term", "label", "weight", "df")})
    rows = near.near_articles(df, "k", "text", least).collect()
    want = classes_of(written, least)
    assert {r["k"]: r["class_id"] for r in rows} == want
    sizes = Counter(want.values())
    assert all(r["kept"] == (want[r["k"]] == r["k"]) and r["members"] == sizes[want[r["k"]]] for r in rows)


def test_no_pair_is_lost_without_first_meetings(spark, written):
    """The exact bound alone finds every similar pair."""
    texts = sorted({t for _, t in written if t})
    df = spark.createDataFrame([(t.encode(), t) for t in texts], "node binary, text string")
    weights = terms.term_weights(df, "node", "text")
    nobody = spark.createDataFrame([], "node binary, label binary")
    met = near.other_meetings(near.rare_terms(weights, 0.75), nobody, 0.75)
    found = {(r["a"].decode(), r["b"].decode()) for r in near.similar_pairs(met, near.vectors_of(weights), 0.75).collect()}
    v = dict(zip(texts, weights_of(texts), strict=True))
    want = {(a, b) for a in texts for b in texts if a.encode() < b.encode() and sum(x * v[b].get(w, 0) for w, x in v[a].items()) >= 0.75}
    assert found == want and len(want) > 20
    # Most of the pairs that share a term never meet.
    sharing = sum(1 for a in texts for b in texts if a < b and v[a].keys() & v[b].keys())
    assert met.count() < sharing / 4


@pytest.mark.parametrize(("block", "entries", "together"), [(7, 1 << 19, 50), (8192, 40, 1), (8192, 1 << 19, 1 << 20)])
def test_blocks_of_texts_meet_without_a_shuffle_of_pairs(spark, written, block, entries, together, monkeypatch):
    """The same pairs whatever the sizes, none within a class, and nothing is shuffled behind the stored blocks."""
    for name, value in (("BLOCK", block), ("ENTRIES", entries), ("TOGETHER", together)):
        monkeypatch.setattr(near, name, value)
    texts = sorted({t for _, t in written if t})[:90]
    df = spark.createDataFrame([(t.encode(), t) for t in texts], "node binary, text string")
    lists = near.rare_terms(terms.term_weights(df, "node", "text"), 0.75).persist()
    one = {t.encode() for t in texts[10:40]}
    labels = spark.createDataFrame([(n, min(one)) for n in sorted(one)], "node binary, label binary")
    met = near.other_meetings(lists, labels, 0.75)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = lists.collect()
    lists.unpersist()
    known = {bytes(r["node"]): (r["last"], r["rests"]) for r in rows}
    vectors = {n: {} for n in known}
    for r in rows:
        vectors[bytes(r["node"])][r["term"]] = r["x"]
    want = set()
    for a in known:
        for b in known:
            shared = vectors[a].keys() & vectors[b].keys()
            if a < b and shared and not (a in one and b in one):
                level = min(known[a][0], known[b][0])
                if sum(vectors[a][t] * vectors[b][t] for t in shared) + known[a][1][level] * known[b][1][level] >= 0.75 - near.SLACK:
                    want.add((a, b))
    found = [(bytes(r["a"]), bytes(r["b"])) for r in met.collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_near_articles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k bigint, text string")
    assert near.near_articles(df, "k", "text").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (101, 102), (7, 7)] + [(500, 500 + i) for i in range(1, 200)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, **{500 + i: 500 for i in range(200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashed_vectors_are_unit_and_aligned(spark, written):
    df = spark.createDataFrame(written, "k bigint, text string")
    rows = {r["k"]: np.array(r["embedding"]) for r in terms.hashed_vectors(df, "k", "text", 512).collect()}
    assert 300 not in rows and 301 not in rows and 302 not in rows
    assert all(len(v) == 512 and abs(np.linalg.norm(v) - 1) < 1e-9 for v in rows.values())
    assert np.allclose(rows[200], rows[230]) and np.allclose(rows[303], rows[304])
    exact = weights_of([t for _, t in written])
    true = [sum(x * exact[j].get(w, 0) for w, x in exact[i].items()) for i in range(40) for j in range(i)]
    made = [rows[i] @ rows[j] for i in range(40) for j in range(i)]
    assert np.abs(np.array(true) - made).max() < 0.35 and np.corrcoef(true, made)[0, 1] > 0.9


def test_recall_of_similar_articles(spark):
    """All neighbours above 0.8, and nine in ten at 0.65 and above, in vectors with clusters."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((60, 48))
    x = np.repeat(centres, 40, axis=0) + r.standard_normal((2400, 48)) * r.choice([0.2, 0.4, 0.55], 2400)[:, None]
    x[7], x[8] = 0, x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "k bigint, embedding array<double>")
    rows = similar.similar_articles(df, F.col("k") % 20 == 9, "k", k=5, least=0.65).collect()
    unit = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    got = {(q["query_id"], q["k"]): q["cosine"] for q in rows}
    wanted = []
    for q in range(9, 2400, 20):
        cosine = np.round(unit @ unit[q], 9)
        cosine[q] = -2
        wanted += [(q, int(i), cosine[i]) for i in sorted(np.flatnonzero(cosine >= 0.65), key=lambda i: (-cosine[i], i))[:5]]
    hit = [(q, i) in got for q, i, _ in wanted]
    near_ = [(q, i) in got for q, i, c in wanted if c >= 0.8]
    assert len(wanted) > 400 and np.mean(hit) > 0.95 and np.mean(near_) > 0.995
    assert all(got[q, i] == pytest.approx(c, abs=1e-8) for q, i, c in wanted if (q, i) in got)


def test_similar_articles_among_copies(spark):
    """A vector that half of all rows share: ties go to the smallest keys, and no one is their own neighbour."""
    rows = [(i, [1.0, 0.0, 1.0]) for i in range(100)] + [(200 + i, [float(i), 1.0, -3.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, embedding array<double>")
    found = similar.similar_articles(df, F.col("k").isin(1, 99), "k", k=3, least=0.9).collect()
    assert sorted((r["query_id"], r["rank"], r["k"]) for r in found) == [(1, 1, 0), (1, 2, 2), (1, 3, 3), (99, 1, 0), (99, 2, 1), (99, 3, 2)]
    assert similar.similar_articles(df.limit(0), F.lit(True), "k").count() == 0


def test_similar_groups(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "day string, embedding array<double>")
    found = similar.similar_groups(df, "day", k=1).collect()
    assert {r["day"]: r["other"] for r in found} == {"a": "b", "b": "a", "c": "b"}


SENTENCES = {
    "es": "el gobierno anunció que las medidas para la economía llegan esta semana y los precios bajan",
    "en": "the government said that the measures for the economy come this week and the prices fall",
    "de": "die Regierung sagte dass die Maßnahmen für die Wirtschaft diese Woche kommen und die Preise fallen",
}


def test_languages(spark):
    r = random.Random(1)
    rows = []
    for i in range(90):
        language = list(SENTENCES)[i % 3]
        words = SENTENCES[language].split()
        rows.append((i, language, " ".join(r.choice(words) for _ in range(8)), "2025-01-01"))
    rows += [(100, None, None, "2025-01-01"), (101, "es", "", "2025-01-02"), (102, None, "123 !", "2025-01-02"), (103, None, "EL GOBIERNO", "2025-01-02"), (104, "es", "a", None)]
    df = spark.createDataFrame(rows, "k bigint, lang string, text string, day string")
    known = languages.profiles(df.filter("k % 2 = 0"), "lang", "text")
    assert known.groupBy("language").count().filter("count > 300").count() == 0
    found = languages.detect_language(df, known, "k", "text")
    got = {r["k"]: r["idioma"] for r in found.collect()}
    assert len(got) == len(rows)
    held = [got[k] == language for k, language, _, _ in rows[:90] if k % 2]
    assert np.mean(held) > 0.95
    assert (got[100], got[101], got[102], got[103]) == (None, None, None, "es")
    shares = {(r["day"], r["idioma"]): (r["n"], round(r["share"], 3)) for r in languages.language_shares(found, "day").collect()}
    assert shares["2025-01-02", None] == (2, 0.667) and shares["2025-01-02", "es"] == (1, 0.333)
    nothing = languages.detect_language(df, known.limit(0), "k", "text")
    assert nothing.filter("idioma IS NULL").count() == len(rows)


def test_profile_order(spark):
    df = spark.createDataFrame([("x", "aaa aaa bbb"), (None, "ccc")], "lang string, text string")
    rows = [(r["triple"], r["gain"]) for r in languages.profiles(df, "lang", "text", 4).orderBy(F.desc("gain")).collect()]
    assert rows == [("_aa", 4), ("aa_", 3), ("aaa", 2), ("_bb", 1)]


def test_similar_articles_in_blocks_are_all_of_them(spark, monkeypatch):
    """No neighbour is missed, and only a query's nearest leave a block of rows."""
    monkeypatch.setattr(similar, "ROWS", 100)
    monkeypatch.setattr(similar, "QUERIES", 20)
    r = np.random.default_rng(3)
    x = np.repeat(r.standard_normal((8, 12)), 50, axis=0) + r.standard_normal((400, 12)) * 0.7
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(f"{i:03}", v.tolist()) for i, v in enumerate(x)], "k string, embedding array<double>")
    rows = similar.similar_articles(df, F.col("k") % 5 == 0, "k", k=4, least=0.5)
    want = set()
    for q in range(0, 400, 5):
        cosine = np.round(unit @ unit[q], 9)
        near_ = sorted((i for i in np.flatnonzero(cosine >= 0.5) if i != q), key=lambda i: (-cosine[i], i))[:4]
        want |= {(f"{q:03}", rank, f"{i:03}") for rank, i in enumerate(near_, 1)}
    assert {(q["query_id"], q["rank"], q["k"]) for q in rows.collect()} == want and len(want) > 200


def test_written_tables_leave_no_shuffle_files(spark):
    from rotativa.session import materialize

    def files():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return folder.getAllFiles().size()

    before = files()
    assert materialize(spark.range(1000).groupBy((F.col("id") % 500).alias("g")).count(), "test").count() == 500
    assert files() <= before + 4  # those of the count itself


def test_text_weights_are_term_weights(spark, written, monkeypatch):
    """The same numbers with a row per text, whatever the size of the chunks; blank texts count and have no row."""
    monkeypatch.setattr(terms, "CHUNK_TERMS", 500)
    df = spark.createDataFrame([(str(k).encode(), t) for k, t in written], "node binary, text string").repartition(3)
    rows = terms.text_weights(df, "node", "text").collect()
    got = {}
    for r in rows:
        parts = (np.frombuffer(r[c], t) for c, t in (("terms", np.int64), ("dfs", np.int32), ("xs", np.float64)))
        for term, often, x in zip(*parts, strict=True):
            got[bytes(r["node"]), int(term)] = (int(often), x)
    want = terms.term_weights(df, "node", "text").withColumn("term", F.xxhash64("term")).collect()
    assert len(rows) == len({bytes(r["node"]) for r in rows}) and len(got) == len(want) > 1000
    assert all(got[bytes(r["node"]), r["term"]] == (r["df"], pytest.approx(r["weight"], abs=1e-12)) for r in want)
    assert terms.text_weights(df.limit(0), "node", "text").count() == 0


def test_entries_meet_only_where_both_rests_allow(spark, monkeypatch):
    """Unlike texts of common words: far fewer products than pairs in the lists that hold three quarters of each text's length."""
    r = random.Random(7)
    texts = [" ".join(sorted({f"w{int(2000 ** r.random())}" for _ in range(120)})) for _ in range(500)]
    df = spark.createDataFrame([(f"{i:03}".encode(), t) for i, t in enumerate(texts)], "node binary, text string")
    vectors = weights_of(texts)
    often = Counter(w for v in vectors for w in v)
    lists = Counter()
    for v in vectors:
        rest = {n: sum(x * x for w, x in v.items() if math.ceil(math.log2(often[w])) > n) ** 0.5 for n in range(12)}
        last = min(n for n in rest if rest[n] < 0.75)
        lists.update(w for w in v if math.ceil(math.log2(often[w])) <= last)
    nobody = spark.createDataFrame([], "node binary, label binary")
    stored = near.blocks_of(near.rare_lists(terms.text_weights(df, "node", "text"), 0.75), nobody).collect()
    products, plain = [], near.ranges
    monkeypatch.setattr(near, "ranges", lambda begin, size: products.append(int(size.sum())) or plain(begin, size))
    assert len(stored) == 1 and stored[0]["strip"] == 0
    block, floor = near.Block(memoryview(stored[0]["data"])), near.floor_of(0.75)
    near.sharing(block, block, floor, 0.75 - floor)
    # Behind the entries that meet, their products; both orders of a pair, and a text with itself, meet in one block.
    before = sum(n * (n - 1) / 2 for n in lists.values())
    assert before > 10_000 and sum(products[1:]) / 2 < before / 2
