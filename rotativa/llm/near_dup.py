"""Near-duplicates by DartMinHash signatures, banded joins and an exact check.

Every weighted element of a document, here each different shingle of five words, throws darts into
the region (weight, time) below its weight. Where they fall depends on the element alone, so
documents that share an element share its darts. A dart belongs to one of ``k`` coordinates; the
earliest dart of each coordinate is the signature, and two documents agree in a coordinate with the
probability of their weighted Jaccard similarity. The time that is searched shrinks with the total
weight, so a document throws about ``k (ln k + 2)`` darts whatever its length.

Texts that agree in a band are candidates. Within a bucket, members first meet one pivot, and
connected texts become a class. Where a bucket still holds several classes, its texts meet in blocks
of a bounded number; a block compares signatures, then sets, and returns only similar pairs that join
two of its classes, so no group is ever written out as pairs. Every link is an exact comparison of
two shingle sets, and the classes are the connected components of all links.

Texts without words (null or empty too) are alike to none. Texts under five words are one shingle.
Rows of one text are one node from the start, so repeated rows join the same class. An empty table
gives an empty result. Texts of any length are read whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.llm.common import SHARES, give_back, hot_keys, possibly_in, text_or_empty, with_parts, worker_state
from rotativa.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6
BATCH_ELEMENTS = 100_000
BLOCK_NODES = 1024
FILE_LINKS = 4096

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([1 / np.e / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)])


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Different shingles of a text as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total = mix(total * _GOLD + hashes[i : i + count])
    return np.unique(total)


def throw(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int):
    """Darts of each element in unit time slabs [begin, end): (document and coordinate, time)."""
    strips = np.ceil(weights).astype(np.int64)
    slabs = end - begin
    cells = strips * slabs
    owner = np.repeat(np.arange(len(elements)), cells)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    slab = begin[owner] + inside % slabs[owner]
    strip = inside // slabs[owner]
    cell = mix(elements[owner] + mix(slab.astype(np.uint64) * _GOLD + strip.astype(np.uint64)))
    darts = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    at = np.repeat(np.arange(len(owner)), darts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[at] + (nth + 1).astype(np.uint64) * _GOLD)
    time = (slab[at].astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
    coordinate = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    place = docs[owner][at] * k + coordinate
    partial = weights != strips
    if partial.any():
        height = strip[at] + (mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        hit = height < weights[owner][at]
        return place[hit], time[hit]
    return place, time


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Signatures (documents x k) of non-empty weighted sets, each (elements, weights)."""
    lengths = np.array([len(e) for e, _ in sets])
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([w for _, w in sets])
    docs = np.repeat(np.arange(len(sets)), lengths)
    total = np.bincount(docs, weights)
    limit = np.ceil(k * (np.log(k) + 2) / total * 2.0**32).astype(np.uint64)  # in the units of time
    signature = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
    begin, open_ = np.zeros(len(sets), np.int64), np.ones(len(sets), bool)
    while True:
        end = ((limit - np.uint64(1)) >> np.uint64(32)).astype(np.int64) + 1
        here = open_[docs]
        place, time = throw(elements[here], weights[here], docs[here], begin[docs[here]], end[docs[here]], k)
        inside = time < limit[place // k]
        np.minimum.at(signature, place[inside], time[inside])
        # A document with an empty coordinate looks again over twice the time.
        open_ = (signature.reshape(-1, k) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            return signature.reshape(-1, k)
        limit = np.where(open_, limit * np.uint64(2), limit)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different from band to band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        total = mix(total * _GOLD + parts[:, :, i])
    return total.view(np.int64)


def signed(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, keys): the text's hash and its band keys; null keys for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]):
        worker_state("near duplicates")  # lets go of what the operator before has kept
        for batch in batches:
            ids, nodes, texts = (batch.column(n) for n in ("doc_id", "node", "text"))
            at = 0
            while at < len(texts):
                first, sets, size = at, [], 0
                while at < len(texts) and size < BATCH_ELEMENTS:
                    sets.append(shingles(texts[at].as_py()))
                    size += max(len(sets[-1]), 600)
                    at += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [None] * len(sets)
                if full:
                    found = band_keys(dart_signatures([(sets[i], np.ones(len(sets[i]))) for i in full], bands * rows), bands, rows)
                    for i, row in zip(full, found, strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids[first:at], nodes[first:at], pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"]
                )
            del batch, ids, nodes, texts  # before the next batch comes
            give_back()

    content = text_or_empty(text)
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(content.cast("binary"))).alias("node"), content.alias("text"))
    return made.mapInArrow(sign, "doc_id bigint, node binary, keys array<bigint>")


def shared_buckets(signatures: DataFrame) -> DataFrame:
    """(key, node) of the buckets with two texts or more.

    Keys are counted first, and a filter of the counted ones keeps the others out of the second shuffle.
    """
    entries = signatures.select("node", F.explode("keys").alias("key"))
    text = F.xxhash64("node")
    counted = entries.groupBy("key").agg(F.min(text).alias("low"), F.max(text).alias("high"), F.count(F.lit(1)).alias("n"))
    several = materialize(counted.filter("low != high").select("key", "n"), "several")
    share = F.greatest(several.agg(F.sum("n")).scalar() / SHARES, F.lit(64.0))
    hot = several.filter(F.col("n") > share).select(F.col("key").alias("_hot_0"), F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    likely = possibly_in(entries, F.col("key"), several.select("key")).filter("_maybe").drop("_maybe")
    parted = with_parts(likely, ["key"], hot).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    copied = with_parts(several.select("key"), ["key"], hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    copied = copied.select("key", F.col("_part").cast("bigint").alias("_part"))
    return parted.join(copied, ["key", "_part"], "left_semi").select("key", "node").distinct()


def shingle_sets(docs: DataFrame, signatures: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of the given texts, each made from the row with the smallest doc_id that has the text."""

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(t.as_py()).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    first = signatures.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi").select("node", identity)
    content = text_or_empty(text)
    texts = docs.select(F.unhex(F.md5(content.cast("binary"))).alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"), content.alias("text"))
    texts = texts.select("node", identity, "text")
    row = F.xxhash64("node", "id")
    likely = possibly_in(texts, row, first.select(row.alias("row"))).filter("_maybe").drop("_maybe")
    # Equal rows are reduced in each task, on the keys of the join.
    wanted = likely.dropDuplicates(["node", "id"]).join(first, ["node", "id"], "left_semi")
    return wanted.select("node", "text").mapInArrow(make, "node binary, shingles array<bigint>")


def check_pairs(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    met = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_x", "_y"))
    ratio = common / (F.size("_x") + F.size("_y") - common)
    return met.filter(ratio >= similarity).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node is connected with.

    Labels are written again and again, so by as many tasks as the links are worth, not by one per shuffle partition.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    files = both.count() // FILE_LINKS + 1
    first = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = materialize(first.coalesce(files), "labels")
    while True:
        # The neighbours' labels, then the label of the label.
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = better.join(jump, "next").select("node", F.least("next", "jump").alias("next"), "label")
        moved = materialize(moved.coalesce(files), "labels")
        if moved.filter("next != label").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("label"))


def with_labels(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets that still hold two classes or more."""
    named = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    ends = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    return named.join(ends.select("key"), "key", "left_semi")


def pivot_pairs(named: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest, unless both are in one class already."""
    chosen = named.groupBy("key").agg(F.min(F.struct("node", "label")).alias("p"))
    met = named.join(chosen, "key").filter("label != p.label")
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def prints(sets: DataFrame, nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, keys, bytes): band keys, and a byte per coordinate."""

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                some = [np.asarray(s.values).view(np.uint64) for s in part.column("shingles")]
                signatures = dart_signatures([(s, np.ones(len(s))) for s in some], bands * rows)
                columns = [
                    part.column("node"),
                    pa.array(list(band_keys(signatures, bands, rows)), pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in mix(signatures).astype(np.uint8)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "keys", "bytes"])

    return sets.join(nodes, "node", "left_semi").mapInArrow(make, "node binary, keys array<bigint>, bytes binary")


def in_blocks(named: DataFrame) -> DataFrame:
    """Add ``i``, ``j`` and ``block``: a bucket is cut into blocks, and each two of them meet once."""
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    cut = named.join(sizes, "key").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK_NODES).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    met = cut.withColumn("block", block).withColumn("_other", other)
    ends = {"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}
    return met.withColumns(ends).drop("_n", "_blocks", "_other")


def likely_pairs(frame: pd.DataFrame, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, agreement) of a block that lie in different classes and seem similar enough.

    The agreement is cut five standard errors below the wanted similarity. A pair is looked at in
    the first bucket that it shares.
    """
    keys, prints_ = np.stack(frame["keys"].to_numpy()), np.stack([np.frombuffer(b, np.uint8) for b in frame["bytes"]])
    label, block = pd.factorize(frame["label"])[0], frame["block"].to_numpy()
    band = np.flatnonzero(keys[0] == frame["key"].iloc[0])[0]
    least = similarity - 5 * np.sqrt(similarity * (1 - similarity) / prints_.shape[1])
    across = frame["i"].iloc[0] != frame["j"].iloc[0]
    for at in range(0, len(frame), 32):
        rows = slice(at, at + 32)
        apart = (label[rows, None] != label) & (np.arange(len(frame))[rows, None] < np.arange(len(frame)))
        if across:
            apart &= block[rows, None] != block
        a, b = np.nonzero(apart & ~(keys[rows, None, :band] == keys[None, :, :band]).any(axis=2))
        agree = (prints_[a + at] == prints_[b]).sum(axis=1, dtype=np.int16) / prints_.shape[1]
        likely = agree >= least
        if likely.any():
            yield a[likely] + at, b[likely], agree[likely]


def active(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The rows of a block that have a likely partner."""
    chosen = np.zeros(len(frame), bool)
    for a, b, _ in likely_pairs(frame, similarity):
        chosen[a] = chosen[b] = True
    return frame.loc[chosen, ["key", "i", "j", "block", "node", "label"]]


def joining(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Similar pairs of a block that connect its classes: a spanning forest, not all pairs."""
    found = list(likely_pairs(frame, similarity))
    if not found:
        return pd.DataFrame({"a": [], "b": []})
    a, b, agree = (np.concatenate(c) for c in zip(*found, strict=True))
    sets = [np.asarray(x).view(np.uint64) for x in frame["shingles"]]
    label, node = pd.factorize(frame["label"])[0].tolist(), frame["node"].tolist()
    parent = list(range(max(label) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    pairs = []
    for n in np.argsort(-agree, kind="stable").tolist():
        x, y = root(label[a[n]]), root(label[b[n]])
        if x != y:
            one, two = sets[a[n]], sets[b[n]]
            both = len(np.intersect1d(one, two, assume_unique=True))
            if both / (len(one) + len(two) - both) >= similarity:
                parent[x] = y
                pairs.append(sorted((node[a[n]], node[b[n]])))
    return pd.DataFrame(pairs, columns=["a", "b"])


def joining_pairs(named: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs that connect different classes within the buckets that still hold several."""
    looks = materialize(prints(sets, named.select("node").distinct()), "prints")
    met = in_blocks(named).join(looks, "node")
    entry = "key bigint, i int, j int, block int, node binary, label binary"
    chosen = met.groupBy("key", "i", "j").applyInPandas(lambda f: active(f, similarity), entry)
    chosen = materialize(chosen, "active")
    # Each set is read once for all blocks of its text that have a likely pair.
    some = looks.join(sets.join(chosen.select("node").distinct(), "node", "left_semi"), "node")
    chosen = chosen.join(some, "node")
    return chosen.groupBy("key", "i", "j").applyInPandas(lambda f: joining(f, similarity), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, node, class_id, first, members): one row per row of ``docs``; a class is named by its smallest doc_id."""
    signatures = materialize(signed(docs, text), "signatures")
    buckets = materialize(shared_buckets(signatures), "buckets")
    sets = materialize(shingle_sets(docs, signatures, buckets.select("node").distinct(), text), "shingles")
    each = buckets.withColumn("label", F.col("node"))
    links = materialize(check_pairs(materialize(pivot_pairs(each), "pairs"), sets, similarity), "found")
    labels = components(links)
    named = materialize(with_labels(buckets, labels), "open")
    labels = components(links.unionAll(materialize(joining_pairs(named, sets, similarity), "joining")))
    members = signatures.select("doc_id", "node", (F.size("keys") > 0).alias("worded"))
    named = members.join(labels, "node", "left").select("doc_id", "node", "worded", F.coalesce("label", "node").alias("label"))
    return first_ids(named)


def first_ids(named: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, first, members) from (doc_id, node, worded, label).

    ``first`` marks the class's smallest (doc_id, node), nulls last; ``members`` counts its rows. A class with many rows is split
    to get its name.
    """
    worded = named.filter("worded").select("doc_id", "node", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    names = worded.groupBy("label").agg(F.min(order).alias("chosen"), F.count(F.lit(1)).alias("members"))
    hot = hot_keys(worded, ["label"])
    parted = with_parts(worded, ["label"], hot).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
    copied = with_parts(names, ["label"], hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    same = order.eqNullSafe(F.col("chosen")).alias("first")
    classes = parted.join(copied.drop("_parts"), ["label", "_part"]).select("doc_id", "node", F.col("chosen.doc_id").alias("class_id"), same, "members")
    alone = named.filter("NOT coalesce(worded, false)").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(True).alias("first"), F.lit(1).cast("bigint").alias("members"))
    return classes.unionAll(alone)


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class; texts without words all stay."""
    node = F.md5(text_or_empty(text).cast("binary"))
    key = lambda n: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), n)
    found = near_duplicates(docs, text).filter("members > 1").select(key(F.lower(F.hex("node"))).alias("key"), "first")
    # Only rows of classes with several meet in a shuffle.
    several = materialize(found.groupBy("key").agg(F.max("first").alias("first")), "several")
    rows = possibly_in(docs.select(F.struct("*").alias("row"), key(node).alias("key")), F.col("key"), several.select("key"))
    likely = rows.filter("_maybe")
    alone = likely.join(several.select("key"), "key", "left_anti")
    chosen = likely.join(several.filter("first").select("key"), "key", "left_semi").dropDuplicates(["key"])
    parts = [rows.filter("NOT _maybe"), alone, chosen]
    return reduce(DataFrame.unionAll, [p.select("row.*") for p in parts])
