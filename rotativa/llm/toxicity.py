"""Toxicity from a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as three vectors: one of the word itself, the mean of the vectors of its character
pieces (beginnings, endings and inner runs), and the last state of a gated recurrent layer that reads its
characters in order. A second such layer reads a window of words in either direction, attention weighs its
states, and a linear layer gives the window's logit. A text is scored by all its windows, half
overlapping; the largest logit, calibrated, is its score.

Training takes a documented, bounded sample of the labelled rows (``MAX_PER_LABEL``) with all their
windows; the model sees text alone. In the first passes a window carries its text's label; then a toxic
text is represented by its most toxic windows. The driver holds the sampled texts as numbers of words.

Null and empty texts have no window and score 0. Without labels of both kinds every score is 0.
Repeated rows score alike, very long texts are read whole, a word beyond ``RUN`` bytes in runs of so many
whose states are averaged. An empty table gives an empty result. Labels that differ for one id count as
toxic. Columns of ``docs`` called held_out, score or predicted are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotativa.llm.common import give_back, id_remainder, text_or_empty, worker_state

WINDOW, STRIDE = 16, 8
BUCKETS, WIDTH, HIDDEN = 1 << 16, 8, 8
RUN = 32
MAX_PER_LABEL = 1000
CALIBRATION_SHARE = 4  # one sampled text in so many is kept from training, for the calibration
EPOCHS, BATCH, RATE, RARE = 5, 256, 0.03, 3
WARM, CLEAR = 1, -4.0  # passes over all windows; the logit below which a clean text's window is learnt
THRESHOLD = 0.7
CACHED_WORDS = 1 << 18
BATCH_WORDS, BATCH_WINDOWS = 120_000, 2048
EDGES = " .,;:!?\"'()[]{}|%*#$&<>«»¡¿"


def pieces(word: str) -> list[int]:
    """Hashes of a word's character pieces; a piece's bucket is its remainder by BUCKETS."""
    w = word.encode()
    found = [crc32(w[:n], 1) for n in range(2, min(len(w), 7) + 1)]
    found += [crc32(w[-n:], 2) for n in range(2, min(len(w), 4) + 1)]
    found += [crc32(w[i : i + 4], 3) for i in range(1, len(w) - 3)]
    return found or [crc32(w, 4)]


def piece_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of all words in turn, and each word's number of pieces."""
    counts = []

    def each() -> Iterator[int]:
        for word in words:
            found = pieces(word)
            counts.append(len(found))
            yield from found

    flat = np.fromiter(each(), np.int64) % BUCKETS
    return flat.astype(np.int32), np.array(counts, np.int64)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words in runs as a matrix, longest first, how many runs have a byte at each place, and each run's word."""
    runs, owner = [], []
    for i, word in enumerate(words):
        w = word.encode() or b" "
        for at in range(0, len(w), RUN):
            runs.append(w[at : at + RUN])
            owner.append(i)
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    lengths = np.array([len(runs[i]) for i in order], np.int64)
    real = np.arange(lengths.max(initial=0)) < lengths[:, None]
    codes = np.zeros(real.shape, np.int64)
    codes[real] = np.frombuffer(b"".join(map(runs.__getitem__, order)), np.uint8)
    return codes, real.sum(axis=0), np.array(owner, np.int64)[order]


def word_bucket(word: str) -> int:
    return crc32(word.encode(), 5) % BUCKETS


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def bare(word: bytes) -> str:
    return word.decode().strip(EDGES)


def window_starts(n: int) -> list[int]:
    """Starts of windows that cover ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters in ``p``; rows of ``p["word"]`` and ``p["char"]`` are buckets."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": np.zeros((BUCKETS, WIDTH), np.float32), "char": np.zeros((BUCKETS, WIDTH), np.float32)}
        for d, width in (("f", 3 * WIDTH), ("b", 3 * WIDTH), ("k", WIDTH)):
            self.p |= {f"W{d}": draw(width, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"letter": draw(256, WIDTH), "A": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}

    @classmethod
    def of(cls, parameters: dict[str, np.ndarray]) -> Network:
        net = cls.__new__(cls)
        net.p = parameters
        return net

    def vectors(self, words: list[str]) -> np.ndarray:
        """Input vectors of words."""
        parts = [self._vectors(words[i : i + 8192]) for i in range(0, len(words), 8192)]
        return np.vstack(parts) if parts else np.zeros((0, 3 * WIDTH), np.float32)

    def _vectors(self, words: list[str]) -> np.ndarray:
        flat, counts = piece_buckets(words)
        sums = np.add.reduceat(self.p["char"][flat], np.cumsum(counts) - counts)
        own = self.p["word"][np.fromiter(map(word_bucket, words), np.int64, len(words))]
        return np.hstack([own, sums / counts[:, None], self.spelled(words)[0]]).astype(np.float32)

    def spelled(self, words: list[str], memory: dict | None = None):
        """The state behind each word's last character, averaged over its runs, and the runs."""
        codes, live, owner = runs = letters(words)
        inputs = self.p["letter"] @ self.p["Wk"] + self.p["ck"]
        last = np.zeros((len(codes), HIDDEN), np.float32)
        for t, n in enumerate(live.tolist()):
            before = last[:n].copy() if memory is not None else last[:n]
            new, z, r, c, u = self.step("k", inputs[codes[:n, t]], before)
            if memory is not None:
                memory[t] = (before, z, r, c, u)
            last[:n] = new
        total = np.zeros((len(words), HIDDEN), np.float32)
        np.add.at(total, owner, last)
        return total / np.bincount(owner, minlength=len(words))[:, None], runs

    def spelled_gradients(self, runs: tuple, memory: dict, d_words: np.ndarray) -> dict[str, np.ndarray]:
        codes, live, owner = runs
        carry = d_words[owner] / np.bincount(owner)[owner][:, None]
        g_u, parts = np.zeros_like(self.p["Uk"]), []
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            g, d_in, carry[:n] = self.step_gradients("k", memory[t], carry[:n])
            g_u += g
            parts.append(d_in)
        at, flat = np.concatenate([codes[:n, t] for t, n in reversed(list(enumerate(live)))]), np.vstack(parts)
        d_in = np.stack([np.bincount(at, flat[:, j], 256) for j in range(flat.shape[1])], axis=1).astype(flat.dtype)
        return {"Uk": g_u, "Wk": self.p["letter"].T @ d_in, "ck": d_in.sum(axis=0), "letter": d_in @ self.p["Wk"].T}

    def step(self, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step of a recurrent layer; ``x`` is already multiplied by the input weights."""
        u = h @ self.p[f"U{d}"]
        gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, u[:, 2 * HIDDEN :]

    def step_gradients(self, d: str, kept: tuple[np.ndarray, ...], d_new: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gradients of the recurrent weights, of the inputs and of the state before, from that of the state behind."""
        h, z, r, n, u = kept
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * u * r * (1 - r)
        d_u = np.hstack([d_z, d_r, d_n * r])
        return h.T @ d_u, np.hstack([d_z, d_r, d_n]), d_new * z + d_u @ self.p[f"U{d}"].T

    def scan(self, d: str, inputs: np.ndarray, ids: np.ndarray, real: np.ndarray, memory: dict | None = None) -> np.ndarray:
        """States of a layer over rows of ``ids``, which number rows of ``inputs``; a cell that isn't real keeps the state."""
        count, steps = ids.shape
        states, full = np.zeros((count, steps, HIDDEN), np.float32), real.all()
        h = np.zeros((count, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if d == "b" else range(steps):
            new, z, r, n, u = self.step(d, inputs[ids[:, t]], h)
            if memory is not None:
                memory[t] = (h, z, r, n, u)
            h = new if full else np.where(real[:, t : t + 1], new, h)
            states[:, t] = h
        return states

    def unscan(self, d: str, memory: dict, ids: np.ndarray, real: np.ndarray, d_states: np.ndarray, size: int):
        """Gradients of the recurrent weights and of the ``size`` rows of the inputs."""
        count, steps = ids.shape
        g_u, carry, parts = np.zeros_like(self.p[f"U{d}"]), np.zeros((count, HIDDEN), np.float32), []
        order = range(steps) if d == "b" else range(steps - 1, -1, -1)
        for t in order:
            there = real[:, t : t + 1]
            total = d_states[:, t] + carry
            g, d_in, before = self.step_gradients(d, memory[t], total * there)
            g_u += g
            carry = before + total * ~there
            parts.append(d_in)
        at, flat = np.concatenate([ids[:, t] for t in order]), np.vstack(parts)
        d_in = np.stack([np.bincount(at, flat[:, j], size) for j in range(flat.shape[1])], axis=1)
        return g_u, d_in.astype(flat.dtype)

    def run(self, inputs: dict[str, np.ndarray], ids: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; ``inputs`` holds each word's products with the input weights per direction."""
        memory = {"f": {}, "b": {}} if keep else {"f": None, "b": None}
        states = np.concatenate([self.scan(d, inputs[d], ids, real, memory[d]) for d in "fb"], axis=2)
        k = np.tanh(states @ self.p["A"])
        weigh = np.where(real, k @ self.p["v"], -1e9)
        weigh = np.exp(weigh - weigh.max(axis=1, keepdims=True))
        weigh /= weigh.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntd->nd", weigh, states)
        logits = pooled @ self.p["o"] + self.p["b"][0]
        return (logits, states, memory, k, weigh, pooled) if keep else logits

    def gradients(self, vectors: np.ndarray, ids: np.ndarray, real: np.ndarray, label: np.ndarray):
        """Loss gradients: a dictionary for the dense parameters, and one row per word of ``vectors``."""
        p = self.p
        inputs = {d: vectors @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        logits, states, memory, k, weigh, pooled = self.run(inputs, ids, real, keep=True)
        e = ((sigmoid(logits) - label) / len(ids)).astype(np.float32)
        g = {"o": pooled.T @ e, "b": e.sum(keepdims=True)}
        d_pooled = e[:, None] * p["o"]
        d_states = weigh[:, :, None] * d_pooled[:, None, :]
        d_weigh = np.einsum("ntd,nd->nt", states, d_pooled)
        d_score = weigh * (d_weigh - (weigh * d_weigh).sum(axis=1, keepdims=True))
        d_k = d_score[:, :, None] * p["v"] * (1 - k * k)
        g["v"] = np.einsum("nth,nt->h", k, d_score)
        g["A"] = np.einsum("ntd,nth->dh", states, d_k)
        d_states += d_k @ p["A"].T
        d_vectors = np.zeros_like(vectors)
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            g[f"U{d}"], d_in = self.unscan(d, memory[d], ids, real, d_states[:, :, side], len(vectors))
            g[f"W{d}"] = vectors.T @ d_in
            g[f"c{d}"] = d_in.sum(axis=0)
            d_vectors += d_in @ p[f"W{d}"].T
        return g, d_vectors


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words: the text of each window, its words' numbers within all words, and which of them are real."""
    starts = [window_starts(n) for n in lengths]
    owner = np.repeat(np.arange(len(lengths)), list(map(len, starts)))
    inside = np.fromiter(chain.from_iterable(starts), np.int64, len(owner))
    real = np.arange(WINDOW) < (lengths[owner] - inside)[:, None]
    at = (np.cumsum(lengths) - lengths)[owner] + inside
    return owner, np.minimum(at[:, None] + np.arange(WINDOW), max(0, lengths.sum() - 1)), real


def train(texts: list[list[str]], labels: list[int], seed: int = 7) -> Network:
    """Fit a network on texts given as words."""
    net, r = Network(seed), np.random.default_rng(seed)
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    words, lengths = list(number), np.array(list(map(len, texts)), np.int64)
    flat_words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int32, lengths.sum())
    owner, at, real = windows_of(lengths)
    ids = flat_words[at]
    label = np.array(labels, np.float32)[owner]
    flat, counts = piece_buckets(words)
    del at
    starts, own = np.cumsum(counts) - counts, np.fromiter(map(word_bucket, words), np.int64, len(words))
    # A bucket that few texts touch would only learn those texts by heart.
    seen = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(words) + flat_words)
    in_texts = np.bincount(seen % len(words), minlength=len(words))
    usual = {
        "word": np.bincount(own, in_texts, BUCKETS) >= RARE,
        "char": np.bincount(flat, np.repeat(in_texts, counts), BUCKETS) >= RARE,
    }
    for name, often in usual.items():
        net.p[name][often] = r.standard_normal((often.sum(), WIDTH)).astype(np.float32) * 0.1
    squares = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}

    def use(rows: np.ndarray) -> None:
        used, back = np.unique(ids[rows], return_inverse=True)
        n = counts[used]
        begin = np.cumsum(n) - n
        touched = flat[np.repeat(starts[used] - begin, n) + np.arange(n.sum())]
        memory: dict = {}
        read, runs = net.spelled([words[i] for i in used.tolist()], memory)
        vectors = np.hstack([net.p["word"][own[used]], np.add.reduceat(net.p["char"][touched], begin) / n[:, None], read])
        g, d_vectors = net.gradients(vectors.astype(np.float32), back.reshape(len(rows), WINDOW), real[rows], label[rows])
        g |= net.spelled_gradients(runs, memory, d_vectors[:, 2 * WIDTH :])
        for k, grad in g.items():
            squares[k] += grad * grad
            net.p[k] -= RATE * grad / np.sqrt(squares[k])
        d_word, d_char = d_vectors[:, :WIDTH], d_vectors[:, WIDTH : 2 * WIDTH]
        for name, index, grad in (("word", own[used], d_word), ("char", touched, np.repeat(d_char / n[:, None], n, axis=0))):
            rows_, inverse = np.unique(index, return_inverse=True)
            total = np.stack([np.bincount(inverse, grad[:, j], len(rows_)) for j in range(WIDTH)], axis=1).astype(np.float32)
            total *= usual[name][rows_][:, None]
            squares[name][rows_] += total * total
            net.p[name][rows_] -= RATE * total / np.sqrt(squares[name][rows_])

    rows = np.arange(len(ids))
    for epoch in range(EPOCHS):
        if epoch >= WARM:
            # Of a toxic text, only the windows that look toxic by now; of the others, those that aren't
            # clearly clean, since the rest would move nothing.
            vectors = net.vectors(words)
            inputs = {d: vectors @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
            logits = np.concatenate([net.run(inputs, ids[i : i + 4096], real[i : i + 4096]) for i in range(0, len(ids), 4096)])
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner, logits)
            rows = np.flatnonzero(np.where(label == 0, logits > CLEAR, logits >= best[owner] - 1))
        order = r.permutation(rows)
        for i in range(0, len(order), BATCH):
            use(order[i : i + BATCH])
    return net


class Scorer:
    """Largest window logit per text. Products of known words are kept as long as the worker lives."""

    def __init__(self, net: Network, name: str):
        self.net = net
        for other in [k for k in worker_state("toxicity") if k != name]:
            del worker_state("toxicity")[other]
        self.kept = worker_state("toxicity").setdefault(name, {})
        if not self.kept:
            self.forget()

    def forget(self, words: int = 0) -> None:
        """No words; room for two rows per word, its own and its bare one, of which only the written ones take memory."""
        self.kept.clear()
        self.kept |= {"row": {}, "used": 0, "x": np.zeros((2 * max(words, CACHED_WORDS), 6 * HIDDEN), np.float32)}

    def learn(self, new: list[bytes]) -> None:
        # Words that differ in the punctuation around them share a row, that of the bare word.
        row, p, bares = self.kept["row"], self.net.p, [bare(w).encode() for w in new]
        fresh = [w for w in dict.fromkeys(bares) if w not in row]
        for at in range(0, len(fresh), 8192):
            some, used = fresh[at : at + 8192], self.kept["used"]
            vectors = self.net.vectors([w.decode() for w in some])
            products = np.hstack([vectors @ p["Wf"] + p["cf"], vectors @ p["Wb"] + p["cb"]])
            self.kept["used"] = end = used + len(some)
            self.kept["x"][used:end] = products
            row.update(zip(some, range(used, end), strict=True))
        row.update((w, row[b]) for w, b in zip(new, bares, strict=True) if w != b)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """-inf for a text without words."""
        words = [split_words(t) for t in texts]
        asked = set().union(*words)
        new = asked.difference(self.kept["row"])
        if new and len(self.kept["row"]) + len(new) > CACHED_WORDS:
            self.forget(len(asked))
            new = asked
        self.learn(sorted(new))
        del asked, new
        row = self.kept["row"]
        flat = np.fromiter(map(row.__getitem__, chain.from_iterable(words)), np.int64)
        lengths = np.array([len(ws) for ws in words])
        owner, at, real = windows_of(lengths)
        result = np.full(len(texts), -np.inf)
        inputs = {"f": self.kept["x"][:, : 3 * HIDDEN], "b": self.kept["x"][:, 3 * HIDDEN :]}
        for i in range(0, len(owner), BATCH_WINDOWS):
            some = slice(i, i + BATCH_WINDOWS)
            np.maximum.at(result, owner[some], self.net.run(inputs, flat[at[some]], real[some]))
        return result


def sampled_ids(labels: DataFrame, learn_from: Column) -> DataFrame:
    """(doc_id, toxic) of at most ``MAX_PER_LABEL`` rows of each label, by a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_PER_LABEL) for v in (0, 1)]
    return some[0].unionAll(some[1])


def sample_texts(docs: DataFrame, ids: DataFrame, text: str = "text") -> list[tuple[int, int, list[str]]]:
    """(doc_id, toxic, words) of the sampled texts, whole. Equal words of all texts are one object."""
    # At most 2 * MAX_PER_LABEL ids, so they may be broadcast; so many texts come back.
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(text).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    known: dict[bytes, str] = {}
    found = []
    for doc, toxic, value in zip(rows["doc_id"], rows["toxic"], rows["text"], strict=True):
        words = []
        for w in split_words(value.as_py()):
            if w not in known:
                known[w] = bare(w)
            words.append(known[w])
        if words:
            found.append((doc.as_py(), int(toxic.as_py()), words))
    return found


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, slightly held back."""
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(slope * logits + shift)
        e, s = weights * (p - labels), weights * p * (1 - p)
        g = np.array([(e * logits).sum() + 0.01 * (slope - 1), e.sum() + 0.01 * shift])
        h = np.array([[(s * logits * logits).sum() + 0.01, (s * logits).sum()], [(s * logits).sum(), s.sum() + 0.01]])
        move = np.linalg.solve(h + np.eye(2) * 1e-3, g)
        slope, shift = slope - float(np.clip(move[0], -0.5, 0.5)), shift - float(np.clip(move[1], -1, 1))
        if np.abs(move).max() < 1e-6:
            break
    return max(slope, 0.05), shift


def with_logits(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """(row, logit): each row as one column, and its logit, null for a text without words."""
    model = docs.sparkSession.sparkContext.broadcast(net.p)
    name = f"{crc32(net.p['char'].tobytes())}"
    # The text travels once, within its row, unless it isn't a plain column of it.
    place = docs.columns.index(text) if docs.dtypes.count((text, "string")) == docs.columns.count(text) == 1 else None
    rows = docs.select(F.struct("*").alias("row"), *([] if place is not None else [text_or_empty(text).alias("text")]))

    def score(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(Network.of(model.value), name)
        for batch in batches:
            texts, at, found = batch.column("text") if place is None else batch.column("row").field(place), 0, []
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            while at < len(texts):
                some = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_WORDS * 6)))
                found.append(scorer(texts[at : at + some].to_pylist()))
                at += some
            logits = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(logits, mask=np.isinf(logits))], names=["row", "logit"])
            del batch, texts  # before the next batch comes
            give_back()

    return rows.mapInArrow(score, T.StructType([rows.schema["row"]]).add("logit", "double"))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text") -> tuple[Network, float, float] | None:
    """Network, slope and shift; None without labels of both kinds."""
    sample = sample_texts(docs, sampled_ids(labels, learn_from), text)
    held = {d for d, _, _ in sample if crc32(str(d).encode(), 9) % CALIBRATION_SHARE == 0}
    learned = [s for s in sample if s[0] not in held]
    if len({t for _, t, _ in learned}) < 2:
        return None
    net = train([w for _, _, w in learned], [t for _, t, _ in learned])
    kinds = [(d, t) for d, t, _ in sample]
    del sample, learned
    spark = docs.sparkSession
    some = [(d, t) for d, t in kinds if d in held] or kinds
    # From an Arrow table, since from a list of rows every executor would start plain Python workers, which then stay.
    some = pa.table({"doc_id": pa.array([d for d, _ in some], pa.int64()), "toxic": pa.array([t for _, t in some], pa.int32())})
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text)).join(F.broadcast(spark.createDataFrame(some)), "doc_id")
    rows = with_logits(chosen.select("doc_id", "toxic", text), net, text).select("row.toxic", "logit").filter("logit IS NOT NULL").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return net, 1.0, 0.0
    label, logits = np.array([r["toxic"] for r in rows]), np.array([r["logit"] for r in rows])
    shares = labels.filter("toxic IN (0, 1)").filter(learn_from).agg(F.avg("toxic")).first()[0]
    weights = np.where(label == 1, shares / label.mean(), (1 - shares) / (1 - label.mean()))
    return net, *calibrate(logits, label, weights)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Labels of ids whose crc32 modulo ``modulus`` is ``held`` are never read for learning.
    """
    docs = docs.drop("held_out", "score", "predicted")
    model = fit(docs, labels, id_remainder("doc_id", modulus) != held, text)
    marked = docs.withColumn("held_out", id_remainder("doc_id", modulus) == held)
    if model is None:
        return marked.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    net, slope, shift = model
    score = F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("logit") * slope + shift))))
    scored = with_logits(marked, net, text).select("row.*", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
