"""Repetition inside a text, from suffix arrays over its words.

The words of many texts form one sequence in which every text ends in a word of its own. Prefix
doubling sorts all suffixes, and a scan along the text gives the longest common prefix of
neighbours. An interval of that array with value n is a substring of n words that occurs at all its
suffixes and cannot be extended to the right at all of them; it is maximal if the words before its suffixes differ
too. Each suffix belongs to its deepest interval, and the spans of the maximal ones are united: the words of
an interval that could be extended to the left lie within the spans of the longer one. The covered fraction and the longest
repeat are what the rule limits.

Null and empty texts have no words and no repeats. Repeated rows get a row each, an empty table an
empty result; texts of any length are read whole, with a few arrays of numbers as long as the text. Ties
don't arise. Extra columns pass through the query's select.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_REPEAT = 8
MAX_COVERED = 0.2
MAX_LONGEST = 50
BATCH_WORDS = 400_000
COMPARED = 64  # words compared at once
SYMBOLS = "#*$%&|<>"


def suffix_order(words: np.ndarray, alike: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix array of a sequence, ranks by the first words, and how many: as doubling reaches within ``alike``.

    Suffixes with equal beginnings share the rank of the first of them; a step sorts only those that
    still share one.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.r_[True, words[order][1:] != words[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    kept, reach, length = rank, 1, 1
    while True:
        counts = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied) or length > n:
            break
        follow = tied + length
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        at = np.lexsort((second, rank[tied]))
        sorted_ = tied[at]
        key = rank[sorted_] * np.int64(n + 1) + second[at]
        # Within its old group, a suffix ranks by the first place of those equal to it.
        starts = np.flatnonzero(np.r_[True, rank[sorted_][1:] != rank[sorted_][:-1]])
        inside = np.arange(len(sorted_)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_)]))
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(sorted_)), 0))
        fresh = rank.copy()
        fresh[sorted_] = rank[sorted_] + inside[first]
        rank, length = fresh, length * 2
        if length <= alike:
            kept, reach = rank, length
    return np.argsort(rank, kind="stable"), kept, reach


def common_prefixes(words: np.ndarray, order: np.ndarray, kept: np.ndarray, reach: int) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; ``kept`` ranks them by ``reach`` words.

    Along the text, a suffix shares at most one word less with its neighbour than the suffix before
    it did, so what was compared once isn't compared again.
    """
    n = len(order)
    shared, same = np.zeros(n, np.int64), np.ones(n - 1, bool)
    for step in range(reach):
        x, y = order[:-1] + step, order[1:] + step
        same &= np.maximum(x, y) < n
        same[same] = words[x[same]] == words[y[same]]
        shared[1:] += same
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tied = np.flatnonzero(kept[order[1:]] == kept[order[:-1]]) + 1
    found, last = 0, -2
    for at in np.sort(order[tied]).tolist():
        found = max(reach, found - 1) if at == last + 1 else reach
        other, last = int(order[place[at] - 1]), at
        room = n - max(at, other)
        found = min(found, room)
        while found < room:
            step = min(COMPARED, room - found)
            differ = words[at + found : at + found + step] != words[other + found : other + found + step]
            equal = int(differ.argmax()) if differ.any() else step
            found += equal
            if equal < step:
                break
        shared[place[at]] = found
    return shared


def intervals(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first and last suffix of every interval of at least ``least`` words, and each edge's deepest interval or -1.

    Suffixes are numbered by their place in the array; edge i lies between suffix i - 1 and suffix i.
    """
    depth, left, right, of_edge = [], [], [], np.full(len(shared) + 1, -1, np.int64)
    stack, before = [], -2
    edges = np.flatnonzero(shared >= least)
    for edge, value in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        if edge != before + 1:
            for i in stack:
                right[i] = before
            stack.clear()
        start = edge - 1
        while stack and depth[stack[-1]] > value:
            start = left[stack[-1]]
            right[stack.pop()] = edge - 1
        if not stack or depth[stack[-1]] < value:
            stack.append(len(depth))
            depth.append(value)
            left.append(start)
            right.append(edge)
        of_edge[edge] = stack[-1]
        before = edge
    for i in stack:
        right[i] = before
    return *(np.array(x, np.int64) for x in (depth, left, right)), of_edge


def maximal(words: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which intervals have suffixes with different words before them; the beginning counts as a word of its own."""
    before = np.where(order > 0, words[order - 1], -1)
    changes = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    return changes[right] > changes[left]


def repeat_spans(words: np.ndarray, order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each position, the words of the deepest interval there if that one is maximal, else 0."""
    depth, left, right, of_edge = intervals(shared, least)
    if not len(depth):
        return np.zeros(len(words), np.int64)
    size = np.r_[depth, 0]  # the last stands for no interval
    one, two = of_edge[:-1], of_edge[1:]
    deepest = np.where(size[one] >= size[two], one, two)
    spans = np.zeros(len(words), np.int64)
    spans[order] = np.where(np.r_[maximal(words, order, left, right), False][deepest], size[deepest], 0)
    return spans


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which words lie in the union of the spans [i, i + lengths[i])."""
    edges = np.zeros(len(lengths) + 1, np.int64)
    starts = np.flatnonzero(lengths)
    edges[starts] += 1
    np.subtract.at(edges, starts + lengths[starts], 1)
    return np.cumsum(edges[:-1]) > 0


def maximal_repeats(words: list, least: int = MIN_REPEAT) -> list[tuple[int, list[int]]]:
    """(words, starts) of the repeated substrings that no word can extend on either side at all places.

    These are the intervals of the array of common prefixes whose suffixes differ in the word before.
    """
    if not words:
        return []
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([names[w] for w in words] + [len(names)], np.int64)
    order, kept, reach = suffix_order(ids, least)
    depth, left, right, _ = intervals(common_prefixes(ids, order, kept, reach), least)
    chosen = np.flatnonzero(maximal(ids, order, left, right)) if len(depth) else []
    return [(int(depth[i]), sorted(order[left[i] : right[i] + 1].tolist())) for i in chosen]


class Measure:
    """Figures of one batch of texts."""

    def __init__(self, window: int, least: int):
        self.window, self.least = window, least

    def __call__(self, texts: list[list[bytes]]) -> list[tuple[int, int, int]]:
        """Per text: words in repeated windows, words in long repeats, words of the longest repeat."""
        names: dict[bytes, int] = {}
        ids, ends = [], []
        for words in texts:
            ids.extend([names.setdefault(w, len(names)) for w in words])
            ids.append(-1)
            ends.append(len(ids))
        sequence = np.array(ids, np.int64)
        stops = np.array(ends) - 1
        sequence[stops] = len(names) + np.arange(len(stops))
        # Suffixes of different texts may share words too, so the text's number leads each word:
        # equal words of two texts are different words.
        own = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
        sequence = own * np.int64(len(names) + len(texts) + 1) + sequence
        order, kept, reach = suffix_order(sequence, min(self.window, self.least))
        shared = common_prefixes(sequence, order, kept, reach)
        longest = np.empty(len(order), np.int64)
        longest[order] = np.maximum(shared, np.r_[shared[1:], 0])
        windows = covered(np.where(longest >= self.window, self.window, 0))
        spans = covered(repeat_spans(sequence, order, shared, self.least))
        at = np.array([0, *ends[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), at) for x in (windows, spans)]
        return list(zip(*[s.tolist() for s in sums], np.maximum.reduceat(longest, at).tolist(), strict=True))


def counted_duplicates(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.encode().split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def measure_repetition(docs: DataFrame, window: int = WINDOW, least: int = MIN_REPEAT) -> DataFrame:
    """doc_id and the figures of its text: words, characters, symbols, repeated lines, windows and spans."""
    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, n_span_words bigint, longest_repeat bigint"
    )

    def measure(batches: Iterator[pa.RecordBatch]):
        figures = Measure(window, least)
        blanks = " \t\n\x0b\x0c\r"

        def done(ids, texts, words):
            found = figures(words)
            rows = [
                (i, len(w), len(t) - sum(map(t.count, blanks)), sum(map(t.count, SYMBOLS)), counted_duplicates(t), *f)
                for i, t, w, f in zip(ids, texts, words, found, strict=True)
            ]
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        ids, texts, words, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = t.as_py() or ""
                ids.append(i.as_py())
                texts.append(text)
                words.append(text.encode().split())
                size += len(words[-1]) + 1
                if size >= BATCH_WORDS:
                    yield done(ids, texts, words)
                    ids, texts, words, size = [], [], [], 0
        if ids:
            yield done(ids, texts, words)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, schema)


def repetition_verdict(max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """True for texts whose repeats cover little and are short."""
    few = F.col("n_span_words") <= F.col("n_words") * max_covered
    return few & (F.col("longest_repeat") <= max_longest)
