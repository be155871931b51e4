"""Approximate nearest neighbours by inner product, with an inverted multi-index.

Each half of a vector is quantised on its own, so K centroids per half make K x K cells. A query
ranks the centroids of either half and walks the pairs in the order of their summed reach with a
heap, until the cells it has passed hold a given share of the vectors. What lies in those cells is
ranked by the exact inner product of the original vectors.

The reach of a centroid is its inner product with the query plus what the vectors around it can add:
the length of its longest residual, over all vectors, times that of the query, at the usual cosine of
two directions, one over the root of the dimension. So cells of long vectors, which win by inner
product, come early however far they lie from the query.

The codebooks are fitted on a bounded sample (``FIT_ROWS``); every vector is indexed. Cells are
packed into blocks of at most ``BLOCK_ROWS`` vectors, a crowded cell into several, and queries into
groups of ``QUERY_ROWS``; a task ranks one group of queries in one block and returns no more than k
rows per query. Three fifths of the vectors are passed by default: vectors without clusters, as in the test
tables, need that for a recall of 0.9.

Vectors that are null, of another length than most, zero, or with null or non-finite components take
no part. Repeated rows of an id and vector count once. A query's own id is never its neighbour. With
fewer than k candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTROIDS = 32
FIT_ROWS = 20_000
FIT_STEPS = 15
PROBE_SHARE = 0.6
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(c: str) -> Column:
    """True for a vector with finite components that are not all zero."""
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(c).isNotNull() & ok & F.exists(c, lambda x: x != 0), F.lit(False))


def fit_codebook(sample: np.ndarray, k: int, steps: int = FIT_STEPS, seed: int = 3) -> np.ndarray:
    """Lloyd's iterations from a random start; an empty centroid moves to the row farthest from its own."""
    r = np.random.default_rng(seed)
    centres = sample[r.permutation(len(sample))[:k]].copy()
    for _ in range(steps):
        distance = (sample**2).sum(axis=1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(axis=1)
        near = distance.argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, sample[:, j], len(centres)) for j in range(sample.shape[1])], axis=1)
        far = np.argsort(-distance.min(axis=1))
        lost = np.flatnonzero(counts == 0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        centres[lost] = sample[far[: len(lost)]]
    return centres


def distances(vectors: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """Squared distance of each half to its centroids."""
    half = books[0].shape[1]
    halves = vectors[:, :half], vectors[:, half:]
    return [(v**2).sum(axis=1)[:, None] - 2 * v @ b.T + (b**2).sum(axis=1) for v, b in zip(halves, books, strict=True)]


def shortfalls(vectors: np.ndarray, books: list[np.ndarray], radii: list[np.ndarray]) -> list[np.ndarray]:
    """The reach of each half's centroids with the sign changed, so that the best come first."""
    half = books[0].shape[1]
    halves = vectors[:, :half], vectors[:, half:]
    usual = [np.sqrt((v**2).sum(axis=1) / max(v.shape[1], 1)) for v in halves]
    return [-(v @ b.T + u[:, None] * r) for v, b, r, u in zip(halves, books, radii, usual, strict=True)]


def nearest_cells(first: np.ndarray, second: np.ndarray, rows_in: np.ndarray, enough: float) -> list[int]:
    """Cells in the order of the sum of ``first`` and ``second`` until they hold ``enough`` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, width = first[a].tolist(), second[b].tolist(), len(b)
    counts = rows_in.reshape(len(a), width)[np.ix_(a, b)].tolist()
    heap, pushed, found, total = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        if counts[i][j]:
            found.append(int(a[i]) * width + int(b[j]))
            total += counts[i][j]
        for m, n in ((i + 1, j), (i, j + 1)):
            if m < len(x) and n < width and (m, n) not in pushed:
                pushed.add((m, n))
                heapq.heappush(heap, (x[m] + y[n], m, n))
    return found


def pack_cells(counts: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """First block and number of blocks of each cell; small cells share a block."""
    first, parts, block, used = {}, {}, 0, 0
    for cell in sorted(counts):
        n = -(-counts[cell] // most)
        if used and (n > 1 or used + counts[cell] > most):
            block, used = block + 1, 0
        first[cell], parts[cell] = block, n
        if n > 1:
            block += n
        else:
            used += counts[cell]
    return first, parts


def rank_block(entries: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best entries of each query among those in its cells."""
    entries = entries.sort_values("vec_id", kind="stable")
    ids, cells = entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
    # Equal vectors are multiplied once, so that they tie exactly and the smaller ids come first.
    names: dict[bytes, int] = {}
    copy = np.array([names.setdefault(v.tobytes(), len(names)) for v in entries["vector"]])
    vectors = np.stack([np.frombuffer(b) for b in names])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        own = some["vec_id"].to_numpy()
        asked = np.stack(some["vector"].to_numpy())
        scores = (asked @ vectors.T)[:, copy]
        passed = np.stack([np.isin(cells, c) for c in some["cells"]])
        scores[~passed | (ids == own[:, None])] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        real = np.take_along_axis(scores, best, axis=1) > -np.inf
        # Summed row by row, a pair has the same score in every block.
        value = (asked[:, None, :] * vectors[copy[best]]).sum(axis=2)
        out.append((np.broadcast_to(own[:, None], best.shape)[real], ids[best][real], value[real]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    vector: str = "embedding",
    probe_share: float = PROBE_SHARE,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, vector) that ``is_query`` marks."""
    spark = rows.sparkSession
    vectors = rows.filter(F.col("vec_id").isNotNull() & usable(vector)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    width = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors = vectors.filter(F.size("vector") == width["n"]).distinct()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("vector").toPandas()
    points = np.stack(sample["vector"].to_numpy())
    half = points.shape[1] // 2
    books = [fit_codebook(p, min(centroids, len(p))) for p in (points[:, :half], points[:, half:])]
    shared = spark.sparkContext.broadcast(books)
    wide = len(books[1])

    def encode(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            if len(batch):
                far = distances(np.stack(batch["vector"].to_numpy()), shared.value)
                (a, b), (ra, rb) = ([d.argmin(axis=1) for d in far], [np.sqrt(np.maximum(d.min(axis=1), 0)) for d in far])
                yield batch.assign(cell=a * wide + b, first_off=ra, second_off=rb)

    encoded = vectors.mapInPandas(encode, "vec_id bigint, vector array<double>, cell bigint, first_off double, second_off double")
    entries = encoded.select("vec_id", "vector", "cell")
    # At most one row per cell. Equal vectors count once, so that copies do not use up a query's share.
    sizes = encoded.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64("vector")).alias("different"),
        F.max("first_off").alias("first_off"), F.max("second_off").alias("second_off"),
    ).collect()
    first, parts = pack_cells({r["cell"]: r["n"] for r in sizes}, BLOCK_ROWS)
    different = np.zeros(len(books[0]) * wide, np.int64)
    for r in sizes:
        different[r["cell"]] = r["different"]
    radii = [np.zeros(len(b)) for b in books]
    for r in sizes:
        for radius, at, off in zip(radii, divmod(r["cell"], wide), (r["first_off"], r["second_off"]), strict=True):
            radius[at] = max(radius[at], off)
    # All of a table that hardly fills the list.
    enough = max(probe_share * different.sum(), 4 * k)
    plan = spark.sparkContext.broadcast((first, parts, different, radii))
    asked = vectors.filter(is_query)
    groups = int(-(-asked.count() // QUERY_ROWS)) or 1

    def probe(batches: Iterator[pd.DataFrame]):
        starts, counts, rows_in, around = plan.value
        for batch in batches:
            if not len(batch):
                continue
            made = []
            for vec_id, vec, a, b in zip(batch["vec_id"], batch["vector"], *shortfalls(np.stack(batch["vector"].to_numpy()), shared.value, around), strict=True):
                by_block: dict[int, list[int]] = {}
                for cell in nearest_cells(a, b, rows_in, enough):
                    for block in range(starts[cell], starts[cell] + counts[cell]):
                        by_block.setdefault(block, []).append(cell)
                made += [(vec_id, vec, block, cells) for block, cells in by_block.items()]
            yield pd.DataFrame(made, columns=["vec_id", "vector", "block", "cells"])

    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group")
    probes = asked.mapInPandas(probe, "vec_id bigint, vector array<double>, block int, cells array<bigint>").select("*", group)

    def place(batches: Iterator[pd.DataFrame]):
        starts, counts, _, _ = plan.value
        for batch in batches:
            part = batch["vec_id"] * 7919 % batch["cell"].map(counts)
            yield batch.assign(block=batch["cell"].map(starts) + part)

    placed = entries.mapInPandas(place, "vec_id bigint, vector array<double>, cell bigint, block int")
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = (
        placed.groupBy("block", "group")
        .cogroup(probes.groupBy("block", "group"))
        .applyInPandas(lambda e, q: rank_block(e, q, k) if len(e) and len(q) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}), FOUND)
    )
    return best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, larger scores first and then smaller ids."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
