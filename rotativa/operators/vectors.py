"""Text vectors, group means, cosine matrix and PCA."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, StandardScaler, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.functions.text import or_default
from rotativa.functions.vectors import as_doubles
from rotativa.session import cut_lineage

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame, text: str, load_encoder: Callable[[], Encoder], out: str = "embedding", batch_size: int = 64
) -> DataFrame:
    """Unit vectors of a text column from any encoder; it is loaded once per task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            vectors = []
            for start in range(0, len(texts), batch_size):
                block = np.asarray(encoder(texts.iloc[start : start + batch_size].tolist()), dtype=np.float32)
                norms = np.linalg.norm(block, axis=1, keepdims=True)
                vectors.extend(block / np.where(norms == 0, 1, norms))
            yield pd.Series(vectors, dtype=object)

    # Otherwise a filter on the vector is pushed below the projection and encodes everything twice.
    return df.withColumn(out, encode.asNondeterministic()(or_default(text)))


def embed_hashed(df: DataFrame, text: str, dims: int = 256, out: str = "embedding") -> DataFrame:
    """Unit TF-IDF vectors of hashed words, made without a model or Python."""
    words = df.withColumn("_text", or_default(text))
    steps = Pipeline(
        stages=[
            Tokenizer(inputCol="_text", outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
        ]
    )
    vectors = steps.fit(words).transform(words)
    return vectors.select(*df.columns, vector_to_array("_unit", "float32").alias(out))


def mean_vectors(df: DataFrame, keys: list[str], vector: str = "embedding", count: str = "count_noticias") -> DataFrame:
    """Element-wise mean vector and row count per group, not normalised again.

    Rows with a null key or vector are dropped and not counted. Each task adds up its own rows
    first, so a group with very many rows sends one vector per task through the shuffle.
    """
    return (
        df.dropna(subset=[*keys, vector])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias(count), Summarizer.mean(array_to_vector(as_doubles(vector))).alias("_mean"))
        .select(*keys, count, vector_to_array("_mean").alias(vector))
    )


def cosine_matrix(df: DataFrame, key: str, vector: str = "embedding", tile_rows: int = 1024) -> DataFrame:
    """Cosine similarity of every two rows of a table of days or other groups; 0 for a zero vector.

    The result has the square of the table's rows, so this is for group tables, not for articles.
    Rows without a vector take no part.

    Rows are hashed to tiles of about ``tile_rows`` and each pair of tiles is one matrix product,
    so a task holds two tiles whatever the size of the table.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), as_doubles(vector).alias("vector"))
    n_tiles = rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / tile_rows)).cast("int").alias("n")).scalar()
    tile = F.pmod(F.xxhash64("key"), n_tiles).cast("int")
    every_tile = F.explode(F.sequence(F.lit(0), n_tiles - 1))
    left = rows.select("key", "vector", tile.alias("row_tile"), every_tile.alias("col_tile"))
    # New names, because the two sides of a cogroup may not share columns.
    right = rows.select(
        F.col("key").alias("other_key"), F.col("vector").alias("other_vector"),
        tile.alias("other_col"), every_tile.alias("other_row"),
    )
    key_type = df.schema[key].dataType.simpleString()

    def unit(block: pa.Table, name: str) -> np.ndarray:
        flat = block[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(block.num_rows, -1)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms == 0, 1, norms)

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        out = pa.schema([("key_a", a.schema.field("key").type), ("key_b", b.schema.field("other_key").type), ("cosine", pa.float64())])
        if a.num_rows == 0 or b.num_rows == 0:
            return out.empty_table()
        row, col = np.indices((a.num_rows, b.num_rows)).reshape(2, -1)
        cosine = unit(a, "vector") @ unit(b, "other_vector").T
        return pa.table([a["key"].take(pa.array(row)), b["other_key"].take(pa.array(col)), pa.array(cosine.ravel())], schema=out)

    return (
        left.groupBy("row_tile", "col_tile")
        .cogroup(right.groupBy("other_row", "other_col"))
        .applyInArrow(product, f"key_a {key_type}, key_b {key_type}, cosine double")
        .withColumnsRenamed({"key_a": f"{key}_a", "key_b": f"{key}_b"})
    )


def pca(df: DataFrame, vector: str = "embedding", k: int = 2) -> DataFrame:
    """Scores of the first ``k`` principal components as ``pc1`` .. ``pck``.

    The sign of a component is not defined; here its largest loading is positive. The input, a
    table of group vectors, is checkpointed because fitting reads it several times.
    """
    rows = cut_lineage(df.withColumn("_v", array_to_vector(as_doubles(vector))))
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False),
            PCA(inputCol="_centred", outputCol="_scores", k=k),
        ]
    ).fit(rows)
    loadings = model.stages[1].pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, i])), i] >= 0 else -1.0 for i in range(k)]
    scores = vector_to_array("_scores")
    return model.transform(rows).select(
        *df.columns, *[(scores[i] * F.lit(signs[i])).alias(f"pc{i + 1}") for i in range(k)]
    )
