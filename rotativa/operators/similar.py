"""The most similar articles of some articles, and the most similar days of every day, by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.functions.vectors import as_doubles, l2_norm, l2_normalize
from rotativa.operators.rank import top_n
from rotativa.operators.vectors import cosine_matrix
from rotativa.session import materialize

LEAST = 0.65
# A task compares about so many queries with about so many rows, and a few queries at once.
QUERIES, ROWS, TOGETHER = 65536, 49152, 128


def nearest_of_block(least: float, k: int):
    """Function of two groups (id, vector), rows and queries: each query's ``k`` most similar other rows."""

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind, found = rows.schema.field("id").type, []
        if rows.num_rows and queries.num_rows:
            # In the order of their ids, so that ties go to the smaller place.
            rows = rows.take(pc.sort_indices(rows, [("id", "ascending")])).combine_chunks()
            x, y = (t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (rows, queries))
            own = pc.fill_null(pc.index_in(queries["id"], value_set=rows["id"].combine_chunks()), -1).to_numpy()
            for at in range(0, len(y), TOGETHER):
                near = y[at : at + TOGETHER] @ x.T
                for n, line in enumerate(near, at):
                    place = np.flatnonzero(line >= least - 1e-9)
                    cosine = np.round(line[place], 9)
                    good = (cosine >= least) & (place != own[n])
                    place, cosine = place[good], cosine[good]
                    first = np.lexsort((place, -cosine))[:k]
                    found.append((np.full(len(first), n), place[first], cosine[first]))
        q, r, c = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ids = [t["id"].take(pa.array(at)).combine_chunks() for t, at in ((queries, q), (rows, r))]
        return pa.Table.from_arrays([ids[0].cast(kind), ids[1].cast(kind), pa.array(c)], names=["query_id", "id", "cosine"])

    return search


def similar_articles(
    df: DataFrame, asked: Column, key: str, vector: str = "embedding", k: int = 10, least: float = LEAST
) -> DataFrame:
    """(query_id, rank, key, cosine): the ``k`` most similar other rows of each row for which ``asked`` holds.

    Only neighbours whose cosine reaches ``least`` count; cosines that agree in nine digits are ties, which go to the smaller key.
    ``key`` names each row once. Rows with a null or zero vector take no part.

    Every query meets every row: rows and queries are dealt into groups, a task compares one group of
    queries with one of rows, and only its ``k`` nearest of each query leave it. So the work
    grows with queries times rows, but no pair is shuffled.
    """
    usable = df.filter(F.col(vector).isNotNull() & (l2_norm(vector) > 0))
    rows = materialize(usable.select(F.col(key).alias("id"), l2_normalize(vector).alias("vector"), asked.alias("asked")), "unit-vectors")
    queries = rows.filter("asked")
    groups, parts = (max(1, -(-t.count() // size)) for t, size in ((rows, ROWS), (queries, QUERIES)))
    turn = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("i"), F.pmod(F.hash("id"), F.lit(parts)).cast("int").alias("j")
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for n, c in ((groups, "i"), (parts, "j"))]
    kind = rows.schema["id"].dataType.simpleString()
    blocks = rows.select(turn[0], every[1], "id", "vector").groupBy("i", "j").cogroup(queries.select(every[0], turn[1], "id", "vector").groupBy("i", "j"))
    scored = blocks.applyInArrow(nearest_of_block(least, k), f"query_id {kind}, id {kind}, cosine double")
    top = top_n(scored, ["query_id"], [F.desc("cosine"), F.col("id")], k)
    return top.select("query_id", "rank", F.col("id").alias(key), "cosine")


def similar_groups(df: DataFrame, key: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """(key, rank, other, cosine): the ``k`` most similar other rows of each row of a table of days or other groups.

    Every pair is compared, in tiles; cosines that agree in nine digits are ties, which go to the smaller
    key. Rows without a vector take no part.
    """
    every = cosine_matrix(df.select(key, as_doubles(vector).alias(vector)), key, vector)
    pairs = every.filter(F.col(f"{key}_a") != F.col(f"{key}_b")).withColumn("cosine", F.round("cosine", 9))
    top = top_n(pairs, [f"{key}_a"], [F.desc("cosine"), F.col(f"{key}_b")], k)
    return top.select(F.col(f"{key}_a").alias(key), "rank", F.col(f"{key}_b").alias("other"), "cosine")
