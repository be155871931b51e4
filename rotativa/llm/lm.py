"""Language-model scores from a weighted backoff automaton.

The states of the automaton are histories. An n-gram seen in training is an arc from its history; a
state's failure arc leads to the history without its first word, and at the end of that chain every
word, known or not, has an arc. Weights are smoothed by a Dirichlet prior: with c(h) the times a
history occurred and c(hw) those it was followed by w,

    P(w | h) = (c(hw) + M P(w | shorter h)) / (c(h) + M),        P(w) = (c(w) + 1) / (N + V + 1),

so an arc weighs log10 P(w | h) and a failure arc log10 M / (c(h) + M); the weights out of a state
add up to one. A text is walked once from left to right: it carries its state, follows failure arcs
down to a state that has an arc for the next word, and adds up what it passes.

The n-grams of the corpus are counted over all training texts without any cut. Texts are dealt into
chunks of about ``CHUNK_BYTES``. A chunk sends each of its different n-grams once, as packed arrays
of 64-bit hashes, to buckets that add up the counts; the buckets answer with the counts of just those
n-grams, in the order asked, and each chunk builds its part of the automaton and walks its texts.
Neither the model nor the vocabulary is ever in one place.

A null or empty text is the end token alone. Repeated rows are counted and scored each, and share a
chunk if their ids are equal too. An empty table gives an empty result. Texts are read whole, and a text
longer than a chunk makes its chunk that long. Ties don't arise; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.llm.common import text_or_empty
from rotativa.llm.near_dup import mix
from rotativa.session import materialize

ORDER = 2
PRIOR = 20.0
CHUNK_BYTES = 8 << 20
PART = 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_END, _BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and of the end."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    tokens = np.empty(len(words) + 1, np.uint64)
    tokens[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    tokens[-1] = _END
    return tokens


def ngrams(texts: list[np.ndarray], order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n from 1; texts are preceded by begin marks."""
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams, total = [flat], flat
    for n in range(1, order):
        before = np.full(len(flat), _BEGIN)
        before[n:] = np.where(inside[n:] >= n, flat[:-n], _BEGIN) if n < len(flat) else before[n:]
        total = mix(total * _GOLD + before + np.uint64(n))
        grams.append(total)
    return grams


def chunk_ngrams(frame: pd.DataFrame, learned: np.ndarray, order: int):
    """Per n: the different n-grams of a chunk, in order, how often each occurs in the learned texts,
    and the place of each token's n-gram among them. Then the tokens of each text."""
    texts = [token_hashes(t) for t in frame["text"]]
    lengths = np.array([len(t) for t in texts])
    counted = np.repeat(learned, lengths)
    keys, counts, places = [], [], []
    for gram in ngrams(texts, order):
        key, place = np.unique(gram, return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(place, counted, len(key)).astype(np.int64))
        places.append(place)
    return keys, counts, places, lengths


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, led by that width."""
    top = int(values.max()) if len(values) else 0
    width = max(1, -(-top.bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return wide.view("<u8").reshape(-1)


def packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so sorted keys stand bucket by bucket."""
    return (keys >> np.uint64(32)).astype(np.int64) * buckets >> 32


class Automaton:
    """States and arcs for the texts of one chunk, with counts from the whole corpus.

    State 0 is the empty history; every seen history of up to ``order - 1`` tokens that the chunk has is a
    state, begin marks included. ``arcs`` are sorted numbers ``state * words + word``, with a ``weight`` and
    the state they lead to, which is the longest history that the chunk has seen by then. State 0 has an arc for every
    word of the chunk, any other state only those seen in training, and ``failure`` leads to the next
    shorter history at the cost ``descent``.
    """

    def __init__(self, keys, counts, places, lengths: np.ndarray, tokens: int, types: int, prior: float):
        self.places, self.lengths = places, lengths
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(len(places[0]), bool)
        first[starts] = True
        order, self.words = len(keys), len(keys[0])
        texts = int(counts[0][np.searchsorted(keys[0], _END)])  # learned texts, as each has one end
        # States: the empty history, the begin marks of 1, 2, ... tokens, then the n-grams of the chunk.
        sizes = [len(k) for k in keys[: order - 1]]
        self.offsets = order + np.cumsum([0, *sizes])
        self.known = np.concatenate([np.ones(1, bool), np.full(order - 1, texts > 0), *[c > 0 for c in counts[: order - 1]]])
        occurred = np.concatenate([np.zeros(1), np.full(order - 1, texts), *counts[: order - 1]])
        self.descent = np.log10(prior / (occurred + prior))
        self.failure = np.maximum(np.arange(len(occurred)) - 1, 0)
        source, word, weight, target = [], [], [], []
        chance = (counts[0] + 1) / (tokens + types + 1)
        for n in range(order):
            some = np.empty(len(keys[n]), np.int64)
            some[places[n]] = np.arange(len(places[n]))  # a token at which each n-gram ends
            if 0 < n:
                history = self.state_before(some, first, n)
                chance = (counts[n] + prior * chance[places[n - 1][some]]) / (occurred[history] + prior)
                arc = counts[n] > 0
            else:
                history, arc = np.zeros(len(some), np.int64), np.ones(len(some), bool)
            if n < order - 1:
                own = slice(self.offsets[n], self.offsets[n + 1])
                self.failure[own] = self.offsets[n - 1] + places[n - 1][some] if n else 0
            source.append(history[arc])
            word.append(places[0][some[arc]])
            weight.append(np.log10(chance[arc]))
            target.append(self.longest(some[arc], min(n + 1, order - 1)))
        arcs = np.concatenate(source) * self.words + np.concatenate(word)
        by_number = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[by_number], np.concatenate(weight)[by_number], np.concatenate(target)[by_number]
        self.first, self.starts, self.order = first, starts, order

    def state_before(self, at: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """The history of ``n`` tokens before each token, seen or not."""
        return np.where(first[at], n, self.offsets[n - 1] + self.places[n - 1][at - 1])

    def longest(self, at: np.ndarray, most: int) -> np.ndarray:
        """The state of the longest seen history, of ``most`` tokens or fewer, that ends with each token."""
        found = np.zeros(len(at), np.int64)
        for n in range(1, most + 1):
            state = self.offsets[n - 1] + self.places[n - 1][at]
            found = np.where(self.known[state], state, found)
        return found

    def walk(self) -> np.ndarray:
        """The weight that each token adds, from left to right.

        Texts are walked side by side, one token a step, each carrying its state. A long text is walked in
        parts of ``PART`` tokens, which start in the state that the tokens before them lead to.
        """
        added = np.zeros(len(self.first))
        parts = -(-self.lengths // PART)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(self.starts, parts) + inside * PART
        size = np.minimum(np.repeat(self.lengths, parts) - inside * PART, PART)
        most = self.order - 1
        state = np.where(inside == 0, most if self.known[most] else 0, self.longest(begin - 1, most))
        by_size = np.argsort(-size, kind="stable")
        begin, size, state = begin[by_size], size[by_size], state[by_size]
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step, "left"))
            at = begin[:live] + step
            word, waiting = self.places[0][at], np.arange(live)
            while len(waiting):
                number = state[waiting] * self.words + word[waiting]
                arc = np.minimum(np.searchsorted(self.arcs, number), len(self.arcs) - 1)
                hit = self.arcs[arc] == number
                added[at[waiting[hit]]] += self.weight[arc[hit]]
                state[waiting[hit]] = self.target[arc[hit]]
                waiting = waiting[~hit]
                added[at[waiting]] += self.descent[state[waiting]]
                state[waiting] = self.failure[state[waiting]]
        return added


def score_texts(docs: DataFrame, learn: Column, order: int = ORDER, prior: float = PRIOR, text: str = "text") -> DataFrame:
    """One row per text, see ``SCORES``. ``learn`` marks the rows to learn from."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text)))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = chunks
    # By id and text, so that a row is in the same chunk whenever it is read again, and copies of a text
    # under many ids don't meet in one.
    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_or_empty(text).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), text_or_empty(text)), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts, _, _ = chunk_ngrams(frame, frame["learn"].to_numpy(), order)
        rows = []
        for n, (k, c) in enumerate(zip(keys, counts, strict=True), 1):
            edges = np.searchsorted(bucket_of(k, buckets), np.arange(buckets + 1))
            rows += [
                (key[0], n, b, packed_sorted(k[low:high]), packed(c[low:high]))
                for b, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))
                if high > low
            ]
        return pd.DataFrame(rows, columns=["chunk", "n", "bucket", "keys", "counts"])

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked_sorted(k) for k in frame["keys"]]
        every, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([unpacked(c) for c in frame["counts"]]).astype(np.int64)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, counts)
        parts = np.split(total[place], np.cumsum([len(a) for a in asked])[:-1])
        return pd.DataFrame({
            "chunk": frame["chunk"], "n": key[0], "bucket": key[1], "counts": [packed(p) for p in parts],
            "tokens": int(total.sum()), "types": int((total > 0).sum()),
        })

    asked = dealt.groupBy("chunk").applyInPandas(ask, "chunk int, n int, bucket int, keys binary, counts binary")
    answered = asked.groupBy("n", "bucket").applyInPandas(answer, "chunk int, n int, bucket int, counts binary, tokens bigint, types bigint")
    answered = materialize(answered, "ngram-counts")
    per_bucket = answered.filter("n = 1").groupBy("bucket").agg(F.first("tokens").alias("tokens"), F.first("types").alias("types"))
    sizes = per_bucket.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = int(sizes["tokens"] or 0), int(sizes["types"] or 0)

    def score(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        learned = frame["learn"].to_numpy()
        keys, _, places, lengths = chunk_ngrams(frame, learned, order)
        answers = answers.sort_values(["n", "bucket"])
        counts = [np.concatenate([unpacked(c) for c in part["counts"]]).astype(np.int64) for _, part in answers.groupby("n")]
        starts = np.cumsum(lengths) - lengths
        walked = Automaton(keys, counts, places, lengths, tokens, types, prior).walk()
        base = np.log10((counts[0] + 1) / (tokens + types + 1))[places[0]]
        return pd.DataFrame({
            "doc_id": frame["doc_id"],
            "held_out": ~learned,
            "n_tokens": lengths,
            "n_known": np.add.reduceat((counts[0] > 0)[places[0]].astype(np.int64), starts),
            "train_tokens": tokens,
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(walked, starts),
        })

    both = dealt.groupBy("chunk").cogroup(answered.drop("tokens", "types").groupBy("chunk"))
    return both.applyInPandas(score, SCORES)
