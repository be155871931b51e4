"""Alignment of two tokenizers' tokens by their bytes, and corpus-wide counts of linked token ids.

A text is encoded by a byte-level vocabulary (A) and by a sentence-piece vocabulary (B). Where a token of
A and a token of B end at the same byte, both streams are cut; the tokens between two cuts form a group,
and every A token of a group is linked with every B token of it. An id pair's count is the number of
documents that hold it linked.

First pass: texts are encoded and dealt to chunks, which are stored, each with its ids, its different
pairs and the number of its documents that hold each. The different pairs of the corpus are dealt to shards by their A id, and
each shard gets a minimal perfect hash of its pairs. Chunks turn their counts into dense vectors that
the hash indexes; the vectors of a shard are added up in a tree, ``FAN`` at a time. Second
pass: each chunk looks its pairs up in the shards, where the key at the hash's place must be the pair
itself, aligns its documents again and adds up what it found. Nothing is broadcast, and no task holds more
than a shard with ``FAN`` chunks' parts of it, or one chunk.

Neither vocabulary joins what a single space or line break between two other characters parts, so both
streams are cut there, and a text is the sequence of such units. A worker keeps the units that it has
encoded, up to a number. A vocabulary for which this does not hold (it is looked up in its pieces) gets whole texts.

Null and empty texts, and texts whose tokens' bytes differ from a space and the text (as where the text has
U+2581), have no tokens: zeros and an empty string. Texts of any length are read whole; a text that is
longer than a chunk is a chunk by itself. Repeated rows count each as a document. An empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.llm.common import worker_state
from rotativa.session import materialize

CHUNK_BYTES = 12 << 20
SHARD_PAIRS = 8192
FAN = 32
BATCH_BYTES = 1 << 20
KEPT_UNITS = 250_000
KEPT_CHARS = 16 << 20
LEARNED_UNITS = 10_000  # at once
LARGE_GROUP = 4096  # links of a group that are written out before equal ones become one
# Fixed value: where byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
STORED = "chunk bigint, docs array<bigint>, sizes array<bigint>, numbers binary, pairs array<bigint>, counts array<bigint>, units array<binary>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.path_a, self.a = path_a, Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.quick = self.quick_a()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_of_letter()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # What precedes an inner space or touches a line break would be joined with it.
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self.line = self.b.encode("\n")

    def quick_a(self):
        """A faster encoder with A's merges for Latin text, or None where A is of another kind."""
        with open(self.path_a, encoding="utf-8") as file:
            parts = json.load(file)
        model, cut = parts["model"], parts["pre_tokenizer"] or {}
        entries, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        # Ids must follow the order of the merges.
        if not level or parts["normalizer"] or model.get("ignore_merges") or any(entries.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
            return None
        import tiktoken

        byte = byte_of_letter()
        ranks = {bytes(byte[c] for c in e): i for e, i in entries.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def units(self, text: str) -> list[str]:
        """Parts of a space and the text that both vocabularies encode apart from each other."""
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each unit by A and by B; none by B where it can't be made to encode the unit by itself."""
        # Newer letters may be known to one library and not to the other.
        slow = [i for i, u in enumerate(units) if not self.quick or max(u) >= "\u0250"]
        a = [[]] * len(units) if len(slow) == len(units) else [self.quick(u) for u in units]
        for i, e in zip(slow, self.a.encode_batch_fast([units[i] for i in slow], add_special_tokens=False), strict=True):
            a[i] = e.ids
        # B puts a space before what it gets; a unit without one comes behind a line break that is taken off.
        b = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        n = len(self.line)
        return a, [ids if u[0] == " " else ids[n:] if ids[:n] == self.line else [] for u, ids in zip(units, b, strict=True)]


def flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array(list(map(len, ids)), np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum()), sizes


def different(x: np.ndarray) -> np.ndarray:
    """Sorted, each number once."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def span_places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of all members of spans, span after span."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Groups:
    """The groups of units that are encoded without loss, from their ids and the bytes of each id.

    Every unit ends where tokens of both sides end, so one cut of all of them cuts each.
    """

    def __init__(self, words: Vocabularies, a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray):
        self.a, self.b, self.units = a, b, len(in_a)
        ends_a, ends_b = np.cumsum(words.size_a[a]), np.cumsum(words.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.of_a, self.of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(common)) for g in (self.of_a, self.of_b))
        self.unit = np.zeros(len(common), np.int64)
        self.unit[self.of_a] = np.repeat(np.arange(len(in_a)), in_a)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, pair, times): each pair is ``A id << 32 | B id``, and stands for so many links.

        Large groups are reduced to their different ids first.
        """
        groups = np.arange(len(self.in_a))
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        large = self.in_a * self.in_b > LARGE_GROUP
        some = groups[~large]
        # Each A token of a group meets the group's B tokens.
        in_a = self.in_a[some]
        per_a = np.repeat(self.in_b[some], in_a)
        left = np.repeat(self.a[span_places(first_a[some], in_a)], per_a)
        right = self.b[span_places(np.repeat(first_b[some], in_a), per_a)]
        found = [(np.repeat(some, in_a * self.in_b[some]), (left << 32) | right, np.ones(len(left), np.int64))]
        for g in groups[large]:
            own_a, n_a = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            own_b, n_b = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            pairs = ((own_a[:, None] << 32) | own_b).ravel()
            found.append((np.full(len(pairs), g), pairs, (n_a[:, None] * n_b).ravel()))
        group, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.unit[group], pair, times

    def texts(self) -> list[str]:
        """Each unit's groups as text; every group ends with a semicolon."""
        group, side = np.concatenate([self.of_a, self.of_b]), np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([self.a, self.b])[order]
        last = np.ones(len(ids), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        marked, back = np.unique(ids * 3 + np.where(last, 1 + side, 0), return_inverse=True)
        parts = [f"{i // 3}{',|;'[i % 3]}" for i in marked.tolist()]
        parts = list(map(parts.__getitem__, back.tolist()))
        ends = np.cumsum(np.bincount(self.unit[group], minlength=self.units)).tolist()
        return ["".join(parts[x:y]) for x, y in zip([0, *ends], ends, strict=False)]


class Units:
    """Encoded units and their pairs, kept as long as the worker lives or until they are too many.

    A word stands for the unit of a space and the word; a word behind a line break for itself.
    """

    def __init__(self, path_a: str, path_b: str):
        self.words = Vocabularies(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        none = np.zeros(0, np.int64)
        self.a, self.b, self.in_a, self.in_b = none, none, none, none
        self.failed = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # where each unit's pairs begin
        self.own = np.zeros(0, np.int32)  # numbers of each unit's different pairs
        self.pairs = none  # by number
        self.sorted = none, none  # pairs in order, and their numbers

    def full(self) -> bool:
        return len(self.at) > KEPT_UNITS or self.chars > KEPT_CHARS

    def learn(self, new: dict[str, str]) -> None:
        """Units by the names that texts are cut into."""
        names, units = list(new), list(new.values())
        for at in range(0, len(names), LEARNED_UNITS):
            self._learn(names[at : at + LEARNED_UNITS], units[at : at + LEARNED_UNITS])

    def _learn(self, names: list[str], units: list[str]) -> None:
        (a, in_a), (b, in_b) = map(flat_ids, self.words.encode(units))
        written = [u.encode() for u in units]
        good = np.ones(len(units), bool)
        for ids, sizes, table in ((a, in_a, self.words.bytes_a), (b, in_b, self.words.bytes_b)):
            tokens = list(map(table.__getitem__, ids.tolist()))
            ends = np.cumsum(sizes)
            spans = np.concatenate([[0], np.cumsum(list(map(len, tokens)))])
            same = spans[ends] - spans[ends - sizes] == list(map(len, written))
            if not same.all() or b"".join(tokens) != b"".join(written):
                same &= [b"".join(tokens[e - n : e]) == w for e, n, w in zip(ends.tolist(), sizes.tolist(), written, strict=True)]
            good &= same
        a, b = a[np.repeat(good, in_a)], b[np.repeat(good, in_b)]
        in_a, in_b = in_a * good, in_b * good
        unit, pair, _ = Groups(self.words, a, in_a, b, in_b).links()
        # Equal pairs of a unit become one.
        key = different(unit << 32 | self._numbered(pair))
        self.at.update(zip(names, range(len(self.at), len(self.at) + len(names)), strict=True))
        self.a, self.b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        self.in_a, self.in_b = np.concatenate([self.in_a, in_a]), np.concatenate([self.in_b, in_b])
        self.failed = np.concatenate([self.failed, ~good])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(key >> 32, minlength=len(names)))])
        self.own = np.concatenate([self.own, (key & 0xFFFFFFFF).astype(np.int32)])
        self.chars += sum(map(len, written))

    def _numbered(self, pair: np.ndarray) -> np.ndarray:
        """The numbers of pairs; new ones get the next."""
        new = np.setdiff1d(different(pair), self.sorted[0], assume_unique=True)
        if len(new):
            pairs = np.concatenate([self.sorted[0], new])
            numbers = np.concatenate([self.sorted[1], np.arange(len(self.pairs), len(self.pairs) + len(new))])
            order = np.argsort(pairs)
            self.sorted = pairs[order], numbers[order]
            self.pairs = np.concatenate([self.pairs, new])
        return self.sorted[1][np.searchsorted(self.sorted[0], pair)]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts in turn, and the number of each text's units; texts without tokens have none."""
        names: list[list[str]] = []
        odd = set()
        for i, text in enumerate(texts):
            if not text:
                names.append([])
            elif self.words.cuts and not ("\n " in text or "\n\n" in text or text[0] == "\n" or text[-1] == "\n"):
                # A word behind a line break begins with one; the break itself stands alone.
                names.append((text.replace("\n", " \n \n") if "\n" in text else text).split(" "))
            else:
                odd.add(i)
                names.append([])
        new = set().union(*names).difference(self.at)
        fit = {w: w if w == "\n" else w[1:] if w[0] == "\n" else " " + w for w in new if w == "\n" or w and not (w.lstrip("\n")[0].isspace() or w[-1].isspace())}
        if len(fit) < len(new):  # blanks that don't stand alone
            new.difference_update(fit)
            odd.update(i for i, words in enumerate(names) if not new.isdisjoint(words))
        # Other units are named by themselves behind a mark that no word begins with.
        for i in odd:
            names[i] = [" " + u for u in self.words.units(texts[i])]
        fit |= {u: u[1:] for u in set().union(*(names[i] for i in odd)).difference(self.at)}
        if fit:
            self.learn(fit)
        counts = np.array(list(map(len, names)), np.int64)
        flat = np.fromiter(map(self.at.__getitem__, chain.from_iterable(names)), np.int64, counts.sum())
        failed = self.failed[flat]
        if failed.any():
            owner = np.repeat(np.arange(len(texts)), counts)
            bad = np.zeros(len(texts), bool)
            bad[owner[failed]] = True
            flat, counts = flat[~bad[owner]], np.where(bad, 0, counts)
        return flat, counts

    def documents_with(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs of some texts, and how many of the texts hold each."""
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        once = different(owner * len(self.at) + flat)
        owner, units = once // len(self.at), once % len(self.at)
        sizes = self.first[units + 1] - self.first[units]
        held = different(np.repeat(owner, sizes) * len(self.pairs) + self.own[span_places(self.first[units], sizes)])
        number = np.bincount(held % len(self.pairs), minlength=len(self.pairs))
        there = np.flatnonzero(number)
        return self.pairs[there], number[there]

    def tokens_of(self, used: np.ndarray) -> list[np.ndarray]:
        """Numbers of ids and ids of the given units, for A and for B."""
        out = []
        for ids, sizes in ((self.a, self.in_a), (self.b, self.in_b)):
            first = np.cumsum(sizes) - sizes
            out += [sizes[used], ids[span_places(first[used], sizes[used])]]
        return out


def units_of_worker(path_a: str, path_b: str) -> Units:
    kept = worker_state("cross tokens")
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Units(path_a, path_b)
    return kept[path_a, path_b]


def slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Consecutive rows with about ``most`` bytes of text each, one row at least."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield slice(at, end)
        at = end


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal pairs added up."""
    pairs, number = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, number, np.concatenate([c for _, c in found]))
    return pairs, total


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as they need, compressed."""
    small = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    head = np.array([small.itemsize, len(small)], np.int64).tobytes()
    return head + pa.compress(small.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, count = np.frombuffer(data[:16], np.int64).tolist()
    plain = pa.decompress(data[16:], width * count, "zstd", asbytes=True) if count else b""
    return np.frombuffer(plain, f"u{width}").astype(np.int64)


def stored_chunks(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Some documents a row, as numbers of units, and a row for each chunk.

    That row has the chunk's different pairs, the number of its documents that hold each, and the ids of
    its units. A chunk ends with ``CHUNK_BYTES`` of text, or where the worker forgets its units, whose
    numbers hold for the chunk only. A task numbers its chunks after its partition; the table is
    stored, so a document stays in its chunk whatever is computed again later.
    """
    longs = pa.list_(pa.int64())
    schema = pa.schema([("chunk", pa.int64()), ("docs", longs), ("sizes", longs), ("numbers", pa.binary()), ("pairs", longs), ("counts", longs), ("units", pa.list_(pa.binary()))])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]):
        units = units_of_worker(path_a, path_b)
        chunk, size, found, used = TaskContext.get().partitionId() << 24, 0, [], []

        def closing() -> pa.RecordBatch:
            own = different(np.concatenate(used))
            return row(chunk, None, None, None, *merged(found), list(map(packed, [own, *units.tokens_of(own)])))

        for batch in batches:
            for part in slices(batch.column("text"), BATCH_BYTES):
                if size >= CHUNK_BYTES or units.full():
                    if found:
                        yield closing()
                        chunk, size, found, used = chunk + 1, 0, [], []
                    if units.full():
                        units.clear()
                some = batch.slice(part.start, part.stop - part.start)
                flat, counts = units.read(some.column("text").to_pylist())
                found.append(units.documents_with(flat, counts))
                used.append(different(flat))
                size += some.column("text").nbytes
                yield row(chunk, some.column("doc_id").to_pylist(), counts, packed(flat), None, None, None)
        if found:
            yield closing()

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, STORED)
    return materialize(made, "token-chunks")


class PerfectHash:
    """A minimal perfect hash of whole numbers: levels of bits, and the rank of a key's bit.

    A key that has its place of a level alone gets the bit there; the others go on to the next level.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum(sizes) - sizes
        self.rank = np.cumsum(bits) - bits

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of different keys."""
        sizes, levels = [], []
        while len(keys):
            size = max(2, len(keys) + len(keys) // 4)
            at = cls.place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *levels]).astype(np.int64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; a number that is no key gets some place or -1."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            at = start + self.place(keys[open_], level, size)
            hit = self.bits[at] == 1
            found[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return found


def shard_hashes(pairs: DataFrame) -> DataFrame:
    """(shard, sizes, bits, keys): a perfect hash of each shard's pairs; ``keys`` in the order of their places."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table["pair"].to_numpy())
        hash_ = PerfectHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[hash_(keys)] = keys
        bits = np.packbits(hash_.bits.astype(bool)).tobytes()
        row = {"shard": [table["shard"][0].as_py()], "sizes": [hash_.sizes], "bits": [bits], "keys": [ordered]}
        return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return pairs.groupBy("shard").applyInArrow(build, "shard bigint, sizes array<bigint>, bits binary, keys array<bigint>")


def hash_of(table: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash and the keys in the first row of ``shard_hashes``."""
    sizes = table["sizes"][0].values.to_numpy()
    bits = np.unpackbits(np.frombuffer(table["bits"][0].as_py(), np.uint8))[: sizes.sum()].astype(np.int64)
    return PerfectHash(sizes, bits), table["keys"][0].values.to_numpy()


def places(hash_: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Places of pairs, which must be keys."""
    at = hash_(pairs)
    if (at < 0).any() or (keys[at] != pairs).any():
        raise ValueError("a pair is not among the keys of its shard")
    return at


def parts_by_shard(chunks: DataFrame, shards: int, nodes: int) -> DataFrame:
    """(shard, node, chunk, pairs, counts): each chunk's pairs, dealt to shards by their A id."""

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for chunk, pairs, counts in zip(batch.column("chunk").to_pylist(), batch.column("pairs"), batch.column("counts"), strict=True):
                pairs, counts = (np.asarray(x.values) for x in (pairs, counts))
                shard = (pairs >> 32) % shards
                order = np.argsort(shard, kind="stable")
                own, first = np.unique(shard[order], return_index=True)
                offsets = pa.array([*first, len(order)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64())) for x in (pairs, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(np.full(len(own), chunk), pa.int64()), *lists], names=["shard", "chunk", "pairs", "counts"]
                )

    made = chunks.mapInArrow(deal, "shard bigint, chunk bigint, pairs array<bigint>, counts array<bigint>")
    return made.withColumn("node", F.pmod(F.xxhash64("chunk"), F.lit(nodes)))


def copies(hashes: DataFrame, nodes: int) -> DataFrame:
    """A copy of each shard's row for every node, under new names, since the sides of a cogroup share none."""
    each = hashes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nodes - 1).cast("long"))))
    return each.withColumnRenamed("shard", "of_shard")


VECTOR = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("vector", pa.list_(pa.int64()))])


def summed_vectors(parts: DataFrame, hashes: DataFrame, nodes: int) -> DataFrame:
    """(shard, vector): counts by place, added up in a tree of ``FAN`` branches."""

    def dense(part: pa.Table, shard: pa.Table) -> pa.Table:
        if not part.num_rows or not shard.num_rows:
            return VECTOR.empty_table()
        hash_, keys = hash_of(shard)
        total = np.zeros(len(keys), np.int64)
        pairs, counts = (x.combine_chunks().flatten().to_numpy() for x in (part["pairs"], part["counts"]))
        np.add.at(total, places(hash_, keys, pairs), counts)
        return pa.table({"shard": part["shard"][:1], "node": part["node"][:1], "vector": [total]}, schema=VECTOR)

    def add(table: pa.Table) -> pa.Table:
        total = table["vector"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"shard": table["shard"][:1], "node": table["node"][:1], "vector": [total]}, schema=VECTOR)

    kind = "shard bigint, node bigint, vector array<bigint>"
    level = parts.groupBy("shard", "node").cogroup(copies(hashes, nodes).groupBy("of_shard", "copy")).applyInArrow(dense, kind)
    while nodes > 1:
        nodes = -(-nodes // FAN)
        level = level.withColumn("node", F.col("node") % nodes).groupBy("shard", "node").applyInArrow(add, kind)
    return level.select("shard", "vector")


def answers(parts: DataFrame, counted: DataFrame, nodes: int) -> DataFrame:
    """(of_chunk, pair, n, best): each chunk's pairs with their counts, and whether none of the same A id is higher."""
    out = pa.schema([("of_chunk", pa.int64()), ("found", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("best", pa.list_(pa.bool_()))])

    def look(part: pa.Table, shard: pa.Table) -> pa.Table:
        if not part.num_rows or not shard.num_rows:
            return out.empty_table()
        hash_, keys = hash_of(shard)
        vector = shard["vector"][0].values.to_numpy()
        ids, number = np.unique(keys >> 32, return_inverse=True)
        highest = np.zeros(len(ids), np.int64)
        np.maximum.at(highest, number, vector)
        top = vector == highest[number]
        lists = part["pairs"].combine_chunks()
        at = places(hash_, keys, lists.flatten().to_numpy())
        offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())
        made = [pa.ListArray.from_arrays(offsets, x) for x in (lists.flatten(), pa.array(vector[at]), pa.array(top[at]))]
        return pa.Table.from_arrays([part["chunk"], *made], schema=out)

    kind = "of_chunk bigint, found array<bigint>, n array<bigint>, best array<boolean>"
    return parts.select("shard", "node", "chunk", "pairs").groupBy("shard", "node").cogroup(copies(counted, nodes).groupBy("of_shard", "copy")).applyInArrow(look, kind)


def unit_results(words: Vocabularies, units: list[np.ndarray], pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Per unit the six sums of a document's result, and the groups as text, some units at a time."""
    in_a, a, in_b, b = units
    sums, written = np.zeros((6, len(in_a)), np.int64), []
    sums[0], sums[1] = in_a, in_b
    end_a, end_b = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b))
    for low in range(0, len(in_a), LEARNED_UNITS):
        high = min(low + LEARNED_UNITS, len(in_a))
        groups = Groups(words, a[end_a[low] : end_a[high]], in_a[low:high], b[end_b[low] : end_b[high]], in_b[low:high])
        unit, pair, times = groups.links()
        at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
        if len(pair) and (not len(pairs) or (pairs[at] != pair).any()):
            raise ValueError("a chunk has a pair that its first pass did not have")
        sums[2, low:high] = np.bincount(groups.unit, minlength=high - low)
        for row, of_link in zip(sums[3:], (times, times * best[at], times * n[at]), strict=True):
            np.add.at(row, low + unit, of_link)
        written += groups.texts()
    return sums, written


def aligned(stored: DataFrame, found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Results of each document, from its chunk's ids and counts."""
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def read(some: pa.Table, known: pa.Table) -> pa.Table:
        worker = units_of_worker(path_a, path_b)
        worker.clear()
        flat = [known[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("found", "n", "best")]
        order = np.argsort(flat[0])
        own, *units = map(unpacked, some.filter(pa.compute.is_valid(some["units"]))["units"][0].as_py())
        sums, written = unit_results(worker.words, units, *(x[order] for x in flat))
        place = np.zeros(int(own.max(initial=0)) + 1, np.int64)
        place[own] = np.arange(len(own))
        made = [kind.empty_table()]
        for docs, sizes, numbers in zip(some["docs"], some["sizes"], some["numbers"], strict=True):
            if not numbers.is_valid:
                continue
            counts, chain_ = sizes.values.to_numpy(), place[unpacked(numbers.as_py())]
            full, starts = counts > 0, np.cumsum(counts) - counts
            rows = np.zeros((6, len(counts)), np.int64)
            for row, of_unit in zip(rows, sums, strict=True):
                if full.any():
                    row[full] = np.add.reduceat(of_unit[chain_], starts[full])
            texts = map(written.__getitem__, chain_.tolist())
            hashes = [hashlib.sha256("".join(islice(texts, c))[:-1].encode()).hexdigest() if c else "" for c in counts.tolist()]
            made.append(pa.Table.from_arrays([docs.values, *map(pa.array, rows), pa.array(hashes, pa.string())], schema=kind))
        return pa.concat_tables(made).combine_chunks()

    sides = stored.select("chunk", "docs", "sizes", "numbers", "units")
    return sides.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(read, RESULT)


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    stored = stored_chunks(docs, path_a, path_b, text)
    chunks = stored.filter("pairs IS NOT NULL").select("chunk", "pairs", "counts")
    each = materialize(chunks.select(F.explode("pairs").alias("pair")).distinct(), "token-pairs")
    shards = max(1, -(-each.count() // SHARD_PAIRS))
    nodes = max(1, -(-chunks.count() // FAN))
    hashes = materialize(shard_hashes(each.withColumn("shard", F.shiftright("pair", 32) % shards)), "token-hashes")
    parts = parts_by_shard(chunks, shards, nodes)
    counted = materialize(hashes.join(summed_vectors(parts, hashes, nodes), "shard"), "token-counts")
    found = answers(parts, counted, nodes)
    return aligned(stored, found, path_a, path_b)
