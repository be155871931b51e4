"""Packing documents into sequences of a fixed number of tokens.

Documents are cut into pieces only where they are longer than a sequence. The plan is made from the
number of pieces of each length, which has at most ``capacity`` entries whatever the number of
documents: the gap that the longest piece leaves is looked up among the sums of one, two and three
lengths, and combinations that fill it exactly are taken as often as the pieces left allow; what
never finds an exact complement goes best-fit into the smallest gap that holds it. Pieces then find
their place by their number among the pieces of their length.

A null or empty text is one piece of one token, the end id. Repeated rows are packed each. An empty
table gives an empty result. Very long texts are tokenized whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotativa.llm.common import numbered, unit_hash, worker_state
from rotativa.session import materialize

CAPACITY = 2048
END_ID = 0
# Two lots of so many words are kept, and texts come to Python so many rows at a time.
CACHED_WORDS = 300_000
BATCH_ROWS = 512
BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # punctuation that never starts a contraction
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes, looked up or else encoded.

    The tokenizer drops blanks and never joins what they part, so a text's ids are those of its
    words in turn. A word of Latin letters, maybe with punctuation behind, is one run of letters to
    the tokenizer, lower-cased, and goes to its merges at once; any other goes the whole way. When
    ``CACHED_WORDS`` are known, they step back; those that come again are kept, the others go with the next lot.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        # The parts alone, as the whole vocabulary as Python objects would take much memory.
        steps, cuts = (
            [x.get("type") for x in (json.loads(part.__getstate__()) if part else {}).get(name, [])]
            for part, name in ((self.tokenizer.normalizer, "normalizers"), (self.tokenizer.pre_tokenizer, "pretokenizers"))
        )
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"]
        self.letters = byte_letters()
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.made(word)
        self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(BEHIND)
        low = core.lower()
        # No letter below U+0250 is changed by normalization but for its case.
        if self.plain and low.isalpha() and max(core) < "\u0250":
            if len(core) < len(text):
                return self[low.encode()] + self[text[len(core) :].encode()]
            if low != core:
                return self[low.encode()]
            written = word.decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.merges.tokenize(written)], "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    vocabulary = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        kept = worker_state("word ids")
        if vocabulary not in kept:
            kept[vocabulary] = WordIds(vocabulary)
        words = kept[vocabulary]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = words.encode(text.as_py()) + end
                for n, first in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[first : first + 4 * capacity]
                    rows.append((doc, n, n * capacity, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def stored_pieces(docs: DataFrame) -> DataFrame:
    """The pieces, written and read again. Whole texts make wide rows, so few of them are in Arrow at once."""
    return materialize(cut_pieces(docs), "pieces", BATCH_ROWS)


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count

    def longest(self) -> int:
        there = np.flatnonzero(self.left)
        return int(there[-1]) if len(there) else 0

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[k]) // n for k, n in Counter(lengths).items())

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths that add up to ``total``, none above ``most``, the larger as large as can be."""
        low, high = (total + 1) // 2, min(most, total - 1)
        if low > high:
            return None
        larger, smaller = self.left[low : high + 1], self.left[total - high : total - low + 1][::-1]
        found = (larger > 0) & (smaller > 0)
        if 2 * low == total and larger[0] < 2:
            found[0] = False
        at = np.flatnonzero(found)
        return (low + int(at[-1]), total - low - int(at[-1])) if len(at) else None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that add up to ``gap``, fewest first."""
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, gap):
            return found
        thirds = np.flatnonzero(self.left[:gap])
        for a in map(int, thirds[thirds * 3 >= gap][::-1]):
            self.left[a] -= 1
            found = self.pair(gap - a, a)
            self.left[a] += 1
            if found:
                return (a, *found)
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece exactly once."""
    stock, patterns, residual = Stock(counts, capacity), [], []
    while longest := stock.longest():
        stock.left[longest] -= 1
        found = stock.complement(capacity - longest) if longest < capacity else ()
        stock.left[longest] += 1
        if found is None:
            times = int(stock.left[longest])
            residual.append((longest, times))
            stock.take((longest,), times)
        else:
            whole = (longest, *found)
            times = stock.times(whole)
            patterns.append((whole, times))
            stock.take(whole, times)
    return patterns + best_fit(residual, capacity)


def best_fit(pieces: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order, many equal pieces at a time."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            insort(gaps, gap)
        open_bins[gap].append((lengths, times))

    for length, count in pieces:
        while count:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, count)
                put(capacity - each * length, (length,) * each, count // each)
                count %= each
                continue
            gap = gaps[at]
            lengths, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            used = min(times, count)
            if times > used:
                put(gap, lengths, times - used)
            put(gap - length, (*lengths, length), used)
            count -= used
    return [bin_ for some in open_bins.values() for bin_ in some]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first piece number, pieces, first sequence, offset), numbering pieces per length."""
    used, rows, sequence = Counter(), [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` should be stored, as it is read for the counts and again for the numbering. The
    counts brought to the driver have one row per length.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = slots(plan_patterns(counts, capacity))
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(tuple(rest))
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by_length.items()}
    # Patterns are made of lengths, so this table is bounded by the capacity, not by the documents.
    plan = spark.sparkContext.broadcast(tables)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string"), F.col("ids_crc32").cast("string"))
    indexed = numbered(pieces.withColumn("_place", unit_hash(key)), ["length"], [], "_place", ("doc_id", "piece")).drop("_place")

    def place(batches):
        for batch in batches:
            lengths, index = (batch.column(n).to_numpy() for n in ("length", "_index"))
            sequence, offset = np.empty(len(index), np.int64), np.empty(len(index), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, _, start, off = plan.value[int(length)]
                at = np.searchsorted(first, index[here], "right") - 1
                sequence[here] = start[at] + index[here] - first[at]
                offset[here] = off[at]
            names = [n for n in batch.schema.names if n != "_index"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return indexed.mapInArrow(place, T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long"))

