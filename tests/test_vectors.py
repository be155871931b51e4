import numpy as np
import pytest
from pyspark.sql import functions as F

from rotativa.functions.vectors import clip, l2_norm, l2_normalize
from rotativa.operators import vectors as v
from rotativa.plans import exploration


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(5)
    return rng.normal(size=(120, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors_df(spark, matrix):
    days = ["hot" if i % 3 == 0 else f"d{i % 7}" for i in range(len(matrix))]
    data = [(d, f"s{i % 2}", m.tolist()) for i, (d, m) in enumerate(zip(days, matrix))]
    return spark.createDataFrame(data + [(None, "s0", matrix[0].tolist())], "fecha_dia string, seccion string, embedding array<float>")


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(l2_norm("v")).collect()] == [5.0, 0.0]
    assert df.select(clip(F.lit(5), 10, 120), clip(F.lit(500), 10, 120)).first()[:] == (10, 120)


@pytest.mark.parametrize("keys", [["fecha_dia"], ["fecha_dia", "seccion"]])
def test_group_means(vectors_df, keys):
    groups = {}
    for r in vectors_df.filter("fecha_dia is not null").collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append(r["embedding"])
    found = v.mean_vectors(vectors_df, keys).collect()
    assert len(found) == len(groups)
    for r in found:
        group = np.array(groups[tuple(r[k] for k in keys)], dtype=np.float64)
        assert r["count_noticias"] == len(group)
        assert np.allclose(r["embedding"], group.mean(axis=0))


@pytest.mark.parametrize("tile_rows", [2, 5, 1024])
def test_cosine_matrix(spark, matrix, tile_rows):
    data = [(f"d{i}", row.tolist()) for i, row in enumerate(matrix[:23])] + [("zero", [0.0] * 8)]
    df = spark.createDataFrame(data, "dia string, embedding array<float>")
    found = {(r["dia_a"], r["dia_b"]): r["cosine"] for r in v.cosine_matrix(df, "dia", tile_rows=tile_rows).collect()}
    assert len(found) == 24 * 24
    unit = matrix[:23].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(23):
        assert found[(f"d{i}", "zero")] == 0
        for j in range(23):
            assert found[(f"d{i}", f"d{j}")] == pytest.approx(unit[i] @ unit[j], abs=1e-9)


def test_pca_matches_svd(spark, matrix):
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "k int, embedding array<float>")
    found = np.array([[r["pc1"], r["pc2"]] for r in v.pca(df).orderBy("k").collect()])
    centred = matrix.astype(np.float64) - matrix.astype(np.float64).mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for i in range(2):
        axis = axes[i] * np.sign(axes[i][np.argmax(np.abs(axes[i]))])
        assert np.allclose(found[:, i], centred @ axis)


def test_embed_with_any_encoder(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string").repartition(1)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    found = sorted(r["embedding"] for r in v.embed(df, "t", load, batch_size=2).collect())
    assert found == [pytest.approx([0.0, 1.0]), pytest.approx([0.0, 1.0]), pytest.approx([2 / 5**0.5, 1 / 5**0.5])]
    for vector in found:
        assert np.linalg.norm(vector) == pytest.approx(1.0, abs=1e-6)


def test_embedding_runs_the_encoder_once(spark):
    df = spark.createDataFrame([("ab", "d")], "t string, fecha_dia string")

    def load():
        return lambda texts: np.ones((len(texts), 2))

    plan = v.embed(df, "t", load).filter("embedding is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(0, "uno dos"), (1, "uno dos"), (2, "otra cosa"), (3, "")], "k int, t string")
    found = {r["k"]: np.array(r["embedding"]) for r in v.embed_hashed(df, "t", dims=64).collect()}
    assert np.allclose(found[0], found[1])
    assert np.linalg.norm(found[0]) == pytest.approx(1, abs=1e-6)
    assert abs(found[0] @ found[2]) < 0.5
    assert len(found[3]) == 64


def test_exploration_flow(spark):
    data = [
        (str(i), "pol" if i % 2 else "eco", f"2025-01-{i % 5 + 1:02d}T22:30:00-03:00", f"titulo {i}", f"u{i}", "b", f"texto numero {i} " * (i + 1))
        for i in range(30)
    ] + [("x", "eco", "sin fecha", "t", "u", "b", "texto")]
    articles = spark.createDataFrame(data, "id string, seccion string, fecha_publicacion string, titulo string, url string, bajada string, texto string")
    prepared = exploration.prepare(articles)
    assert prepared.count() == 30
    embeddings = exploration.news_embeddings(prepared)
    assert embeddings.columns == ["id", "fecha_dia", "seccion", "url", "titulo", "embedding"]
    days = exploration.daily_embeddings(embeddings)
    assert {r["fecha_dia"]: r["count_noticias"] for r in days.collect()} == {f"2025-01-0{d}": 6 for d in range(2, 7)}
    located = exploration.daily_map(days)
    assert located.columns == ["fecha_dia", "count_noticias", "pc1", "pc2", "marker_size"]
    assert {r["marker_size"] for r in located.collect()} == {10}
    assert exploration.section_map(embeddings).count() == 10
    with pytest.raises(ValueError, match="seccion"):
        exploration.prepare(articles.drop("seccion"))
