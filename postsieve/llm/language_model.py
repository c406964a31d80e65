"""Document log-likelihood by a gated recurrent language model with a class-factored output."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import LOWER, UPPER, id_remainder, stored
from postsieve.llm.tokens import stretches

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_COUNT_LIMIT = 400_000
#: Characters of texts that are read in lanes together: enough that the longest text does not leave most lanes empty.
_TOGETHER = 16_000_000
#: Characters of texts that are split into words together; of longer stretches only the words' numbers are held.
_SPLIT = 2_000_000
_LN10 = np.log(10.0)
#: One in so many hashes of training texts is spare; shares that the network can be given of a token's probability.
SPARE = 32
TRUSTS = (0.01, 0.1, 0.25, 0.5, 0.65, 0.8, 0.95)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a whole text in UTF-8, A-Z lower-cased; the end of the document is not among them."""
    return (text or "").encode().translate(_LOWER).split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` of all texts, one after another, and where each text's words begin, with the end of the last."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    # White space at an end of a text leaves an empty word there.
    real = pc.greater(pc.binary_length(words), 0)
    kept, begins = (np.concatenate([[0], np.cumsum(x)]) for x in (real.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()))
    return words.filter(real), kept[begins]


@dataclass
class Vocabulary:
    """The most frequent words, in classes by rank; other words are told by a class of their last bytes.

    Token 0 is the end. Tokens up to ``len(head)`` are words with a place in their class; ``tails`` further ones stand for all
    other words, known or not, whose share inside the class comes from the corpus counts.
    """

    head: list[bytes]
    tails: int
    in_class: int
    log_count: np.ndarray  # log10(count + 0.5) of the end and of each head word
    tail_norm: np.ndarray  # log10(tokens + 0.5 (words + 1)) of each tail class
    norm: float  # log10(N + 0.5 (V + 1))
    total: int

    @property
    def words(self) -> int:
        return len(self.head) + 1

    @property
    def groups(self) -> int:
        return -(-self.words // self.in_class)

    def tail_of(self, word: bytes) -> int:
        return zlib.crc32(word[-3:]) % self.tails


class _Numbers:
    """Token numbers of words; other words than those of the head have the number of their tail class."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.head = vocabulary, pa.array(vocabulary.head, pa.binary())

    def of(self, words: pa.Array) -> np.ndarray:
        number = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy() + np.int32(1)
        other = np.flatnonzero(number == 0)
        ends = pc.binary_slice(words.take(pa.array(other)), -3).dictionary_encode()
        classes = np.array([self.vocabulary.tail_of(x) for x in ends.dictionary.to_pylist()], np.int32)
        number[other] = self.vocabulary.words + classes[ends.indices.to_numpy()]
        return number


class Gru:
    """Gated recurrent unit with an input table, class logits, and word logits inside the classes of frequent words."""

    def __init__(self, vocabulary: Vocabulary, size: int = 16, seed: int = 3):
        random = np.random.default_rng(seed)
        n, words, groups = vocabulary.words + vocabulary.tails, vocabulary.words, vocabulary.groups
        self.size, self.words, self.groups, self.in_class = size, words, groups, vocabulary.in_class
        f = np.float32
        self.p = {
            "x": random.normal(0, 0.1, (n, 3 * size)).astype(f), "h": random.normal(0, 0.25, (size, 3 * size)).astype(f), "b": np.zeros(3 * size, f),
            "c": random.normal(0, 0.05, (size, groups + vocabulary.tails)).astype(f), "cb": np.zeros(groups + vocabulary.tails, f),
            "w": random.normal(0, 0.05, (groups, size, self.in_class)).astype(f), "wb": np.zeros((groups, self.in_class), f),
        }
        # Output biases start at the corpus frequencies; places without a word are shut.
        count = 10.0 ** vocabulary.log_count
        inside = np.full((groups, self.in_class), 1e-30)
        inside.reshape(-1)[: words] = count
        self.p["wb"] = np.log(inside).astype(f)
        self.p["cb"] = np.log(np.concatenate([inside.sum(1), 10.0 ** vocabulary.tail_norm])).astype(f)
        # Log probabilities of tokens by the corpus frequencies alone.
        alone = np.concatenate([count, 10.0 ** vocabulary.tail_norm])
        self.alone = np.log(alone / alone.sum())
        self.trust = 0.8
        # Output weights start with larger sums of squares: words that are rare must not be pushed down before they are met.
        self.squares = {k: np.full(v.shape, 1e-5 if k in ("c", "cb", "w", "wb") else 1e-8, f) for k, v in self.p.items()}

    def steps(self, tokens: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list]:
        """States before each token for lanes of tokens (time x lane); ``fresh`` marks first tokens of documents. Also what the way back needs.

        Gates lie apart (gate x time x lane x part), so that each step works on whole runs of memory.
        """
        k, p = self.size, self.p
        n, lanes = tokens.shape
        out, (inner, new), gates = np.empty((n + 1, lanes, k), np.float32), np.empty((2, n, lanes, k), np.float32), np.empty((2, n, lanes, k), np.float32)
        table, parts = (p["x"] + p["b"]).reshape(-1, 3, k), np.ascontiguousarray(p["h"].reshape(k, 3, k).transpose(1, 0, 2))
        for g in (0, 1):
            np.take(-table[:, g], tokens, axis=0, out=gates[g], mode="clip")
        given, begins = np.take(table[:, 2].copy(), tokens, axis=0), [np.flatnonzero(x) for x in fresh]
        a, out[0] = np.empty((2, lanes, k), np.float32), state
        with np.errstate(over="ignore"):  # a gate that is shut
            for t in range(n):
                before, gate, now, after = out[t], gates[:, t], new[t], out[t + 1]
                if len(begins[t]):
                    before[begins[t]] = 0
                np.matmul(before, parts[:2], out=a)
                gate -= a
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.matmul(before, parts[2], out=inner[t])
                np.multiply(gate[1], inner[t], out=now)
                now += given[t]
                # The hyperbolic tangent, as 1 - 2 / (1 + exp(2x)).
                now *= 2
                np.exp(now, out=now)
                now += 1
                np.divide(-2, now, out=now)
                now += 1
                np.subtract(before, now, out=after)
                after *= gate[0]
                after += now
        self.last = out[n]
        return out[:n], [inner, *gates, new, begins]

    def log_probability(self, states: np.ndarray, tokens: np.ndarray, back: bool = False):
        """Natural log probability of tokens (flat) after states; with ``back`` also the gradient of its sum."""
        p, n, k = self.p, len(tokens), self.size
        head = tokens < self.words
        group = np.where(head, tokens // self.in_class, self.groups + tokens - self.words)
        # Biases are the weights of one more part of the state that is always 1.
        c, w = np.vstack([p["c"], p["cb"]]), np.concatenate([p["w"], p["wb"][:, None]], axis=1)
        whole = np.ones((n, k + 1), np.float32)
        whole[:, :k] = states
        logits = whole @ c
        out, part, at = _log_softmax(logits, group, _small(c))
        # Head words by class: one product a class, all else over all of them at once.
        order = np.flatnonzero(head)
        order = order[np.argsort(group[order].astype(np.uint16), kind="stable")]
        own = group[order]
        ends = np.searchsorted(own, np.arange(self.groups + 1)).tolist()
        present = [(g, x, y) for g, (x, y) in enumerate(zip(ends, ends[1:])) if x < y]
        s = whole[order]
        inner = np.empty((len(order), self.in_class), np.float32)
        for g, x, y in present:
            np.matmul(s[x:y], w[g], out=inner[x:y])
        inside, share, place = _log_softmax(inner, tokens[order] - own * self.in_class, _small(w))
        out[order] += inside
        if not back:
            return out
        # A row's gradient is its place less its softmax. Its exponentials less their sum at the place are that times the negative sum.
        part, share = -part[:, None], -share[:, None]
        logits.reshape(-1)[at] += 1 / part[:, 0]
        inner.reshape(-1)[place] += 1 / share[:, 0]
        d_state = logits @ p["c"].T
        d_state *= part
        whole *= part
        d_c, d_w, d_s, s_scaled = whole.T @ logits, np.zeros_like(w), np.empty((len(order), k), np.float32), s * share
        for g, x, y in present:
            np.matmul(s_scaled[x:y].T, inner[x:y], out=d_w[g])
            np.matmul(inner[x:y], p["w"][g].T, out=d_s[x:y])
        d_s *= share
        d_state[order] += d_s
        return out, {"c": d_c[:-1], "cb": d_c[-1], "w": d_w[:, :-1], "wb": d_w[:, -1], "state": d_state}

    def learn(self, tokens: np.ndarray, fresh: np.ndarray, real: np.ndarray, state: np.ndarray, rate: float, least: int = 1) -> None:
        """One ascent step on a window, the gradient cut at its start. ``real`` marks tokens that are not filling.

        The gradient is a mean over the tokens, or over ``least`` if there are fewer: a thin window, such as the last ones of a few very long
        texts, then moves the weights by no more than its part of a full one.
        """
        states, (inner, z, r, new, begins) = self.steps(tokens, fresh, state)
        after = self.last
        flat = np.flatnonzero(real.reshape(-1))
        k, p, n = self.size, self.p, max(least, len(flat))
        _, up = self.log_probability(states.reshape(-1, k)[flat], tokens.reshape(-1)[flat], back=True)
        into = np.zeros(states.shape, np.float32)
        into.reshape(-1, k)[flat] = up.pop("state")
        # What a change of the state after a step does to the step's parts, for all steps at once.
        of_new, of_z, of_r = (1 - z) * (1 - new * new), (states - new) * z * (1 - z), inner * r * (1 - r)
        # Changes of what goes into the gates and the new part, the last one before its gate; d_new: after it.
        d, d_new = np.empty((3, *states.shape), np.float32), np.empty(states.shape, np.float32)
        carry, back, given = np.zeros_like(state), np.ascontiguousarray(p["h"].reshape(k, 3, k).transpose(1, 2, 0)), np.empty((3, *state.shape), np.float32)
        for t in range(len(tokens) - 1, -1, -1):
            np.multiply(carry, of_new[t], out=d_new[t])
            np.multiply(carry, of_z[t], out=d[0, t])
            np.multiply(d_new[t], of_r[t], out=d[1, t])
            np.multiply(d_new[t], r[t], out=d[2, t])
            np.matmul(d[:, t], back, out=given)
            carry *= z[t]
            carry += given[0]
            carry += given[1]
            carry += given[2]
            carry += into[t]
            if len(begins[t]):
                carry[begins[t]] = 0
        d_h = np.matmul(states.reshape(-1, k).T, d.reshape(3, -1, k)).transpose(1, 0, 2).reshape(k, 3 * k)
        # Rows of the input table: their summed gradients.
        rows = np.empty((tokens.size, 3 * k), np.float32)
        order = np.argsort(tokens.reshape(-1).astype(np.uint16) if len(p["x"]) < 1 << 16 else tokens.reshape(-1), kind="stable")
        for g, x in enumerate((d[0], d[1], d_new)):
            np.take(x.reshape(-1, k), order, axis=0, out=rows[:, g * k : (g + 1) * k], mode="clip")
        sorted_tokens = tokens.reshape(-1)[order]
        at = np.flatnonzero(np.diff(sorted_tokens, prepend=-1))
        seen, sums = sorted_tokens[at], _sums(rows, at)
        grads = up | {"h": d_h, "b": sums.sum(0)}
        for name, g in grads.items():
            g = np.clip(g / n, -1, 1)
            self.squares[name] += g * g
            p[name] += rate * g / np.sqrt(self.squares[name])
        sums /= n
        squares = self.squares["x"][seen] + sums * sums
        self.squares["x"][seen] = squares
        p["x"][seen] += rate * sums / np.sqrt(squares)
        self.last = after


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at ``at``. Two columns of an even number are added as one complex number."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, at, axis=0)
    return np.add.reduceat(rows.view(np.complex64), at, axis=0).view(np.float32)


def _small(weights: np.ndarray) -> bool:
    """Whether no state (parts between -1 and 1, the last one 1) makes exponentials that overflow, or only such as vanish."""
    reach, bias = np.abs(weights[..., :-1, :]).sum(-2), weights[..., -1, :]
    return bool((bias + reach).max() < 60 and (bias - reach).max(-1).min() > -60)


def _log_softmax(logits: np.ndarray, at: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the softmax of each row at one place. ``logits`` become their exponentials; also what these are to be multiplied with for the softmax, and the places in all."""
    if not small:
        logits -= logits.max(1, keepdims=True)
    at = np.arange(0, logits.size, logits.shape[1]) + at
    out = logits.reshape(-1)[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    out -= np.log(total)
    return out, 1 / total, at


def lanes_of(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents one after another in at most ``most`` lanes, longest lane first: tokens (time x lane), number of each token's document (-1: filling), first tokens."""
    n = min(most, max(1, len(docs)))
    lanes: list[list[int]] = [[] for _ in range(n)]
    loads = np.zeros(n, dtype=np.int64)
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        lane = int(loads.argmin())
        lanes[lane].append(i)
        loads[lane] += len(docs[i])
    time = int(loads.max(initial=0))
    tokens, owner, fresh = np.zeros((time, n), np.int32), np.full((time, n), -1, np.int32), np.zeros((time, n), bool)
    for lane, own in enumerate(lanes[i] for i in np.argsort(-loads, kind="stable")):
        t = 0
        for i in own:
            tokens[t : t + len(docs[i]), lane], owner[t : t + len(docs[i]), lane], fresh[t, lane] = docs[i], i, True
            t += len(docs[i])
    return tokens, owner, fresh


def windows(tokens: np.ndarray, owner: np.ndarray, fresh: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of ``window`` steps over the lanes that still have tokens: the first ones, as lanes go from long to short."""
    for t in range(0, len(tokens), window):
        live = int((owner[t] >= 0).sum())
        yield tokens[t : t + window, :live], owner[t : t + window, :live], fresh[t : t + window, :live]


def _learn_all(gru: Gru, docs: list[np.ndarray], lanes: int, window: int, rate: float) -> None:
    """One pass over whole documents, the state carried from window to window; every window moves the weights."""
    tokens, owner, fresh = lanes_of(docs, lanes)
    state = np.zeros((tokens.shape[1], gru.size), np.float32)
    for part, own, first in windows(tokens, owner, fresh, window):
        gru.learn(part, first, own >= 0, state[: part.shape[1]], rate, lanes * window)
        state = gru.last


def score_documents(gru: Gru, docs: list[np.ndarray], lanes: int = 512, window: int = 16, trust: float | None = None) -> np.ndarray:
    """Natural log probability of each document's tokens by class and place, without the share inside tail classes.

    Each token's probability is ``trust`` (default: the network's own) times the network's plus the rest times the corpus frequency, which
    bounds what a network of little data can lose.
    """
    return _mixed(gru, docs, [gru.trust if trust is None else trust], lanes, window)[0]


def _mixed(gru: Gru, docs: list[np.ndarray], trusts: Sequence[float], lanes: int = 512, window: int = 16) -> np.ndarray:
    """``score_documents`` for several values of ``trust`` (value x document) from one reading of the documents."""
    tokens, owner, fresh = lanes_of(docs, lanes)
    state, out, shares = np.zeros((tokens.shape[1], gru.size), np.float32), np.zeros((len(trusts), len(docs))), np.exp(gru.alone)
    for part, own, first in windows(tokens, owner, fresh, window):
        states, _ = gru.steps(part, first, state[: part.shape[1]])
        state = gru.last
        real = own.reshape(-1) >= 0
        got = gru.log_probability(states.reshape(-1, gru.size)[real], part.reshape(-1)[real])
        got, alone, at = np.exp(got.astype(np.float64)), shares[part.reshape(-1)[real]], own.reshape(-1)[real]
        for k, trust in enumerate(trusts):
            out[k] += np.bincount(at, weights=np.log(trust * got + (1 - trust) * alone), minlength=len(docs))
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (UTF-8) and its count over all rows of ``texts`` (one text column). Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in batches:
            for some in _texts(batch.column(0), _TOGETHER):
                new = [split_words(x)[0].value_counts() for x in _texts(some, _SPLIT)]
                both = pa.concat_tables([seen, *(pa.table({"word": x.field(0), "n": x.field(1)}) for x in new)])
                seen = both.group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
                if len(seen) > _COUNT_LIMIT:
                    yield from seen.to_batches()
                    seen = seen.slice(0, 0)
        yield from seen.to_batches()
        del seen
        _give_back()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, documents: int, head: int, tails: int, in_class: int) -> Vocabulary:
    """From counts of all words: the driver takes the ``head`` most frequent and two sums for each tail class."""
    top = counts.orderBy(F.desc("n"), "word").limit(head).collect()
    words, times = [bytes(r["word"]) for r in top], [r["n"] for r in top]
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    given = counts.sparkSession.sparkContext.broadcast(Vocabulary(words, tails, in_class, np.zeros(0), np.zeros(0), 0.0, 0))

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = given.value, np.zeros((2, tails), dtype=np.int64)
        numbers = _Numbers(known)
        for batch in batches:
            number = numbers.of(batch.column(0)) - known.words
            c, n = number[number >= 0], batch.column(1).to_numpy()[number >= 0]
            np.add.at(sums, (0, c), n)
            sums[1] += np.bincount(c, minlength=tails)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tails)), pa.array(sums[0]), pa.array(sums[1])], names=["c", "n", "v"])

    sums = np.zeros((2, tails))
    for r in counts.select("word", "n").mapInArrow(of_class, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sums[:, r["c"]] = r["n"], r["v"]
    total, distinct = whole["n"] + documents, whole["v"] + (documents > 0)
    return Vocabulary(
        words, tails, in_class, np.log10(np.array([documents, *times]) + 0.5), np.log10(sums[0] + 0.5 * (sums[1] + 1)),
        float(np.log10(total + 0.5 * (distinct + 1))), int(total))


def spare(text: Column) -> Column:
    """Whether a training text is kept for the choice of the network's share; all copies of a text are, or none."""
    return F.pmod(F.xxhash64(text), F.lit(SPARE)) == 0


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    return stretches(pc.utf8_length(texts).fill_null(0).to_pylist(), most)


def _texts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    for i, j in _runs(texts, most):
        yield texts[i:j]


def _places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, all words of the texts as places among them, and each text's number of words."""
    split = [(words.dictionary_encode(), np.diff(begins)) for words, begins in map(split_words, _texts(texts, _SPLIT))]
    every = pa.concat_arrays([x.dictionary for x, _ in split]).dictionary_encode()
    place, starts = every.indices.to_numpy(), np.cumsum([0, *(len(x.dictionary) for x, _ in split)])
    places, sizes = np.concatenate([place[x.indices.to_numpy() + i] for (x, _), i in zip(split, starts)]), np.concatenate([n for _, n in split])
    split.clear()
    _give_back()
    return every.dictionary, places, sizes


def _give_back() -> None:
    """Arrow's freed memory to the system: a worker holds it through the long steps that follow else, and when it idles."""
    pa.default_memory_pool().release_unused()


def _ended(numbers: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The tokens of each text, with the end."""
    ends = np.cumsum(sizes)
    return np.split(np.insert(numbers, ends, 0), ends[:-1] + np.arange(1, len(ends)))


def _numbered(texts: pa.Array | list[str | None], numbers: _Numbers) -> list[np.ndarray]:
    found = []
    for some in _texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), _SPLIT):
        words, begins = split_words(some)
        found += _ended(numbers.of(words), np.diff(begins))
    _give_back()
    return found


def choose_trust(gru: Gru, vocabulary: Vocabulary, texts: DataFrame) -> float:
    """The one of ``TRUSTS`` that makes all of ``texts`` (one text column) most likely; the network's present one if there are none."""
    given = texts.sparkSession.sparkContext.broadcast((gru, vocabulary))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = given.value
        numbers, sums, seen = _Numbers(known), np.zeros(len(TRUSTS)), False
        for batch in batches:
            for some in _texts(batch.column(0), _TOGETHER):
                sums += _mixed(model, _numbered(some, numbers), TRUSTS).sum(1)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(TRUSTS)), pa.array(sums)], names=["trust", "log"])

    rows = texts.mapInArrow(weigh, "trust double, log double").groupBy("trust").agg(F.sum("log").alias("log")).collect()
    return max(rows, key=lambda r: r["log"])["trust"] if rows else gru.trust


def train(spark_docs: DataFrame, vocabulary: Vocabulary, size: int, window: int, warm_rows: int, rate: float, lanes: int) -> Gru:
    """Weights from all of ``spark_docs`` (one text column): each task goes on from common weights over its documents, then weights are averaged.

    The common weights come from a first pass over ``warm_rows`` distinct texts chosen by hash; it only spares the tasks a cold start. Texts that are ``spare``
    (one in ``SPARE``, so their number grows with the input) are not learned from at first: all of them, each once, choose how far the network is trusted. Then
    tasks go on over them too, from the averaged weights. Averages weigh tasks by their documents and are taken on the cluster, a slice of the weights at a
    time; the driver gets one set of weights.
    """
    spark = spark_docs.sparkSession
    gru = Gru(vocabulary, size)
    mine, checks = spark_docs.filter(~spare(F.col("text"))), stored(spark, spark_docs.filter(spare(F.col("text"))), "spare")
    firsts = mine.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(warm_rows).agg(F.max("h")).first()[0]
    if firsts is not None:
        warm = sorted(r[0] for r in mine.filter(F.xxhash64("text") <= firsts).distinct().collect())
        _learn_all(gru, _numbered(warm, _Numbers(vocabulary)), 32, window, rate)
    slice_size = 4096

    def moved(texts: DataFrame, label: str) -> DataFrame:
        """Weights in slices after each task's texts, from the present ones."""
        start = spark.sparkContext.broadcast((gru, vocabulary))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, known = start.value
            own, numbers, seen = Gru.__new__(Gru), _Numbers(known), 0
            own.__dict__.update(model.__dict__)
            own.p, own.squares = ({k: v.copy() for k, v in d.items()} for d in (model.p, model.squares))
            for batch in batches:
                for some in _texts(batch.column(0), _TOGETHER):
                    _learn_all(own, _numbered(some, numbers), lanes, window, rate)
                    seen += len(some)
            if seen:
                flat = np.concatenate([own.p[k].reshape(-1) for k in sorted(own.p)])
                cuts = range(0, len(flat), slice_size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(range(len(cuts))), pa.int32()), pa.array([float(seen)] * len(cuts)), pa.array([flat[c : c + slice_size] for c in cuts], pa.list_(pa.float32()))],
                    names=["at", "rows", "w"])

        return stored(spark, texts.mapInArrow(learn, "at int, rows double, w array<float>"), label)

    def average(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        mean = np.average(np.stack(group["w"].to_list()), axis=0, weights=group["rows"])
        return pd.DataFrame({"at": [key[0]], "w": [mean]})

    def take(weights: DataFrame) -> None:
        parts = weights.groupBy("at").applyInPandas(average, "at int, w array<float>").collect()
        if parts:
            flat = np.concatenate([r["w"] for r in sorted(parts, key=lambda r: r["at"])]).astype(np.float32)
            for k in sorted(gru.p):
                gru.p[k], flat = flat[: gru.p[k].size].reshape(gru.p[k].shape), flat[gru.p[k].size :]

    learned = moved(mine, "weights")
    take(learned)
    gru.trust = choose_trust(gru, vocabulary, stored(spark, checks.distinct(), "spare-once"))
    take(learned.unionByName(moved(checks, "spare-weights")))
    return gru


_SCORED = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_head", pa.list_(pa.int64())),
    ("head_sum", pa.list_(pa.float64())), ("net_sum", pa.list_(pa.float64())), ("words", pa.list_(pa.binary())), ("places", pa.binary()),
])
_SCORED_DDL = ("block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_head array<long>, "
               "head_sum array<double>, net_sum array<double>, words array<binary>, places binary")


def score(docs: DataFrame, head: int = 2047, tails: int = 64, in_class: int = 64, size: int = 16, window: int = 16,
          warm_rows: int = 200, rate: float = 0.03, lanes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text).

    Ids whose CRC-32 leaves 1 when divided by 5 are held out. Counts of all words of all other documents give the base score, the classes, and each word's share inside its
    tail class; the network's weights come from the same documents, and every window of them moves the weights. The state runs on from window to window, over any length of text.
    The network tells ``head`` words apart, whatever the size of the corpus; all others it sees as ``tails`` classes by their last three bytes.
    Probabilities sum to one over the known words and one unknown word for each tail class.

    Null text is empty: one token, the end. A null id is hashed as empty text. Repeated rows and equal ids each come out and each count. Without
    training documents all counts are zero. The driver holds ``head`` words and one set of weights. Words outside the head are looked up once for each block
    of about ``_TOGETHER`` characters, so joining them to their counts has no hot key, and the shuffle holds no row for a token.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (id_remainder(F.col(f"`{id_col}`")) == 1).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    learning = rows.filter("NOT held_out").select("text")
    counts = stored(spark, word_counts(learning), "word-counts")
    vocabulary = vocabulary_of(counts, learning.count(), head, tails, in_class)
    gru = train(learning, vocabulary, size, window, warm_rows, rate, lanes)
    given = spark.sparkContext.broadcast((gru, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for a block of texts: their figures, the other words than those of the head, and where these stand."""
        model, known = given.value
        numbers, block = _Numbers(known), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in _runs(batch.column(2), _TOGETHER):
                words, at, sizes = _places(batch.column(2)[i:j])
                number = numbers.of(words)
                tail = number >= known.words
                got = score_documents(model, _ended(number[at], sizes)) / _LN10
                text, of_head, of_tail = np.repeat(np.arange(j - i), sizes), np.zeros(len(words)), np.zeros(len(words))
                of_head[~tail], of_tail[tail] = known.log_count[number[~tail]], known.tail_norm[number[tail] - known.words]
                head_sum, tail_sum, n_head = (np.bincount(text, x[at], j - i).astype(float) for x in (of_head, of_tail, ~tail))
                row = [block, batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist(), sizes + 1, n_head.astype(np.int64) + 1, head_sum + known.log_count[0], got - tail_sum,
                       words.filter(pa.array(tail)), (np.cumsum(tail) - 1)[at[tail[at]]].astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) if isinstance(x, pa.Array) else pa.array([x], f.type) for x, f in zip(row, _SCORED)], schema=_SCORED)
                block += 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text of a block, with the sums over its other words' counts."""
        for batch in batches:
            for r in range(batch.num_rows):
                of = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                found, n_tokens, n_head = of["found"].values, of["n_tokens"].values, of["n_head"].values
                counted = np.zeros(of["n_words"].as_py(), dtype=np.int64)
                counted[found.field("i").to_numpy()] = found.field("n").to_numpy()
                places, sizes = np.frombuffer(of["places"].as_py(), "<i4"), n_tokens.to_numpy() - n_head.to_numpy()
                text = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.bincount(text, of_word[places], len(sizes)).astype(kind) for of_word, kind in ((np.log10(counted + 0.5), np.float64), (counted > 0, np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*(of[x].values for x in ("doc_id", "held_out", "n_tokens", "n_head", "head_sum", "net_sum")), *map(pa.array, sums)],
                    names=["doc_id", "held_out", "n_tokens", "n_head", "head_sum", "net_sum", "tail_sum", "n_tail"])

    # Each block asks for each of its words once, and gets the counts of those that are known.
    half = stored(spark, rows.mapInArrow(run, _SCORED_DDL), "scored")
    asked = half.select("block", F.posexplode("words").alias("i", "word")).join(counts, "word")
    back = asked.groupBy("block").agg(F.collect_list(F.struct("i", "n")).alias("found"))
    sized = half.withColumn("n_words", F.size("words")).drop("words").join(back, "block", "left")
    whole = sized.withColumn("found", F.coalesce("found", F.array().cast("array<struct<i:int,n:bigint>>"))).mapInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_head long, head_sum double, net_sum double, tail_sum double, n_tail long")
    end_known = vocabulary.log_count[0] > np.log10(0.75)
    return whole.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.col("n_tail") - F.lit(0 if end_known else 1)).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(vocabulary.norm)).alias("base_score"),
        (F.col("net_sum") + F.col("tail_sum")).alias("score"),
    )
