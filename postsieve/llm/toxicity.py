"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.common import LOWER, UPPER, id_remainder, stored
from postsieve.llm.tokens import slices

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLEAN = bytes.maketrans((UPPER + _MARKS).encode(), (LOWER + " " * len(_MARKS)).encode())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return value


_HASHES = _Hashes()


def word_rows(text: str | None, bits: int) -> np.ndarray:
    """Two table rows for each word of a text (A-Z lower-cased, ASCII marks apart): shape (words, 2). Row 0 is the padding."""
    found = np.array(list(map(_HASHES.__getitem__, (text or "").encode().translate(_CLEAN).split())), dtype=np.int64)
    mask = (1 << bits) - 2
    return np.stack([found & mask, (found >> 31) & mask], axis=1) + 1


@dataclass
class Network:
    """Embedding rows, filters of each width (width x dimension x filters), output weights, and the scale fitted last."""

    bits: int
    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def projected(self) -> np.ndarray:
        """What each table row adds to every filter at every place: (rows, places x filters)."""
        return np.concatenate([self.table @ self.filters[w][k] for w in sorted(self.filters) for k in range(w)], axis=1).astype(np.float32)

    def pooled(self, rows: list[np.ndarray], table: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Per text the maximum of each filter; also all filter values, and where each text starts among the padded words."""
        widest = max(self.filters)
        flat = np.zeros((sum(len(r) + widest for r in rows), 2), dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum([len(r) + widest for r in rows])))
        for r, b in zip(rows, begin):
            flat[b : b + len(r)] = r
        each = table[flat[:, 0]] + table[flat[:, 1]]
        n, at, values, best = self.out.size // len(self.filters), 0, [], []
        for w in sorted(self.filters):
            total = each[:, at : at + n].copy()
            for k in range(1, w):
                total[:-k] += each[k:, at + k * n : at + (k + 1) * n]
            at += w * n
            values.append(total)
            best.append(np.maximum.reduceat(total, begin[:-1], axis=0) + self.bias[w])
        return np.maximum(np.concatenate(best, axis=1), 0), values, begin

    def logits(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        rows = [word_rows(x, self.bits) for x in texts]
        return self.pooled(rows, table)[0] @ self.out + self.out_bias

    def scores(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        a, b = self.scale
        z = a * self.logits(texts, table) + b if self.constant is None else None
        return np.full(len(texts), self.constant) if z is None else 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _new_network(positive: np.ndarray, negative: np.ndarray, share: float, bits: int, dimension: int = 8, filters: int = 8,
                 widths: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> Network:
    """The first embedding coordinate starts at the smoothed log odds of a row's words (numbers of toxic and other texts with it), the others at small random values."""
    random = np.random.default_rng(seed)
    n = filters * len(widths)
    net = Network(
        bits, random.normal(0, 0.05, (1 << bits, dimension)), {w: random.normal(0, 0.2, (w, dimension, filters)) for w in widths},
        {w: np.zeros(filters) for w in widths}, np.abs(random.normal(0.3, 0.1, n)))
    smooth = 3.0
    net.table[:, 0] = np.log((positive + smooth * share) / (positive + negative + smooth)) - np.log(share)
    net.table[:, 0] -= np.log((negative + smooth * (1 - share)) / (positive + negative + smooth)) - np.log(1 - share)
    net.table[0] = 0
    for w in widths:
        net.filters[w][:, 0, :] = np.abs(net.filters[w][:, 0, :]) + 0.3 / w
    return net


def _numbers(net: Network) -> np.ndarray:
    """All learned numbers in one row."""
    parts = [net.table, *[net.filters[w] for w in sorted(net.filters)], *[net.bias[w] for w in sorted(net.bias)], net.out, np.array([net.out_bias])]
    return np.concatenate([x.reshape(-1) for x in parts])


def _with_numbers(net: Network, numbers: np.ndarray) -> Network:
    made, at = replace(net, filters=dict(net.filters), bias=dict(net.bias)), 0

    def take(like: np.ndarray) -> np.ndarray:
        nonlocal at
        at += like.size
        return numbers[at - like.size : at].reshape(like.shape).astype(float)

    made.table = take(net.table)
    for w in sorted(net.filters):
        made.filters[w] = take(net.filters[w])
    for w in sorted(net.bias):
        made.bias[w] = take(net.bias[w])
    made.out, made.out_bias = take(net.out), float(numbers[-1])
    return made


class _Learner:
    """Adagrad on the log loss of the texts of one task; max pooling passes the gradient to one window for each text and filter."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps, self.table = net, rate, 0, net.projected()
        self.squares = {k: 1e-6 for k in [("out", None), *[("filters", w) for w in net.filters], *[("bias", w) for w in net.bias]]}
        self.table_squares = np.full(len(net.table), 1e-4)

    def step(self, some: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        net, widths, filters = self.net, sorted(self.net.filters), self.net.out.size // len(self.net.filters)
        dimension = net.table.shape[1]
        self.steps += 1
        if self.steps % 20 == 0:
            self.table = net.projected()
        pooled, values, begin = net.pooled(some, self.table)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
        error = weight * (p - y) / len(some)
        back = error[:, None] * net.out * (pooled > 0)
        grads = {("out", None): pooled.T @ error}
        padded = np.zeros((begin[-1] + max(widths), 2), dtype=np.int64)
        for r, b in zip(some, begin):
            padded[b : b + len(r)] = r
        touched, moves = [], []
        for j, w in enumerate(widths):
            g = back[:, j * filters : (j + 1) * filters]
            top = np.stack([values[j][a:b].argmax(axis=0) + a for a, b in zip(begin[:-1], begin[1:])])
            spots = padded[top[:, :, None] + np.arange(w)]
            grads["filters", w] = np.einsum("bf,bfkd->kdf", g, net.table[spots].sum(axis=3))
            grads["bias", w] = g.sum(axis=0)
            touched.append(spots.reshape(-1, 2))
            moves.append(np.einsum("bf,kdf->bfkd", g, net.filters[w]).reshape(-1, dimension))
        for (name, w), grad in grads.items():
            self.squares[name, w] = self.squares[name, w] + grad**2
            change = self.rate * grad / np.sqrt(self.squares[name, w])
            if name == "out":
                net.out = np.maximum(net.out - change, 0)
            else:
                getattr(net, name)[w] = getattr(net, name)[w] - change
        net.out_bias -= self.rate * float(error.sum())
        for c in range(2):
            spot, move = np.concatenate(touched)[:, c], np.concatenate(moves)
            np.add.at(self.table_squares, spot, (move**2).sum(axis=1))
            np.add.at(net.table, spot, -self.rate * move / np.sqrt(self.table_squares[spot])[:, None] * 0.5)
        net.table[0] = 0


def _word_counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every table row, in how many toxic and other texts it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[y][np.unique(word_rows(text, bits))] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], names=["at", "positive", "negative"])

    positive, negative = np.zeros(1 << bits), np.zeros(1 << bits)
    found = rows.select("text", "y").mapInArrow(count, "at long, positive long, negative long")
    for r in found.groupBy("at").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")).collect():
        positive[r["at"]], negative[r["at"]] = r["positive"], r["negative"]
    return positive, negative


def _learned(net: Network, rows: DataFrame, weights: tuple[float, float], rate: float, batch_rows: int = 32, piece: int = 1 << 16) -> Network:
    """One pass over all rows: every task learns from its own, and the results are averaged by their numbers of rows."""
    given = rows.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, n = _Learner(_with_numbers(given.value, _numbers(given.value)), rate), 0
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=int)
            for i, j in slices(texts, 400_000):
                for k in range(i, j, batch_rows):
                    at = slice(k, min(k + batch_rows, j))
                    learner.step([word_rows(x, learner.net.bits) for x in texts[at]], y[at], np.array(weights)[y[at]])
            n += len(texts)
        numbers = _numbers(learner.net).astype(np.float32)
        for at in range(0, len(numbers) if n else 0, piece):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([float(n)]), pa.array([numbers[at : at + piece]], pa.list_(pa.float32()))], names=["at", "n", "w"])

    def average(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = sum(w.astype(float) * n for w, n in zip(group["w"], group["n"])) / group["n"].sum()
        return pd.DataFrame({"at": [key[0]], "w": [total]})

    parts = rows.select("text", "y").mapInArrow(learn, "at long, n double, w array<float>").withColumn("part", F.spark_partition_id())
    pieces = sorted((r["at"], r["w"]) for r in parts.groupBy("at").applyInPandas(average, "at long, w array<double>").collect())
    return _with_numbers(net, np.concatenate([np.array(w) for _, w in pieces]))


def _logits(net: Network, rows: DataFrame) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = given.value.projected()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts, 400_000):
                z = given.value.logits(texts[i:j], table)
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(1)[i:j], batch.column(2)[i:j]], names=["z", "y", "lang"])

    return rows.select("text", "y", "lang").mapInArrow(run, "z double, y int, lang string")


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _platt(logits: DataFrame) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression, a few Newton steps with a small ridge; the driver sees five sums a step."""
    a, b, z = 1.0, 0.0, F.col("z")
    for _ in range(50):
        p = _sigmoid(a * z + b)
        s = p * (1 - p)
        gz, g, szz, sz, s1 = logits.agg(F.sum((p - F.col("y")) * z), F.sum(p - F.col("y")), F.sum(s * z * z), F.sum(s * z), F.sum(s)).first()
        step = np.linalg.solve(np.array([[szz + 0.1, sz], [sz, s1 + 0.1]]), np.array([gz + 0.1 * (a - 1), g + 0.1 * b]))
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.01), b


def _thresholds(logits: DataFrame, scale: tuple[float, float], steps: int = 4096) -> dict[str, float]:
    """For each language the score, a multiple of 1 / ``steps``, from which on flagging gives the best F1 over all its rows; 0.5 where a class is missing."""
    binned = logits.select(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(_sigmoid(scale[0] * F.col("z") + scale[1]) * steps).alias("bin"), "y")
    counts = binned.groupBy("lang", "bin").agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    down, whole = Window.partitionBy("lang").orderBy(F.desc("bin")), Window.partitionBy("lang")
    toxic = F.sum("hits").over(whole)
    f1 = 2 * F.sum("hits").over(down) / (F.sum("n").over(down) + toxic)
    best = counts.select("lang", "bin", f1.alias("f1"), ((toxic > 0) & (toxic < F.sum("n").over(whole))).alias("both")).groupBy("lang").agg(
        F.max_by("bin", F.struct("f1", "bin")).alias("bin"), F.first("both").alias("both"))
    return {r["lang"]: r["bin"] / steps if r["both"] else 0.5 for r in best.collect()}


def _first_texts(rows: DataFrame, n: int) -> list[str | None]:
    """The first ``n`` texts by hash. Tasks send hashes to find them by, not texts: ``n`` of each task would grow with the tasks."""
    mixed = F.xxhash64("text")
    hashes = [r[0] for r in rows.select(mixed.alias("h")).orderBy("h").limit(n).collect()]
    found = rows.filter(mixed <= F.lit(hashes[-1])).groupBy("text").agg(F.count("*").alias("n"))
    texts = found.orderBy(F.xxhash64("text"), "text").limit(n).collect()
    return [x for r in texts for x in [r["text"]] * min(r["n"], n)][:n]


def train(rows: DataFrame, bits: int = 16, passes: int = 4, rate: float = 0.05) -> Network:
    """The network from all of ``rows`` (text, y, lang). Four fifths of the texts, by hash, fit the weights; the others set
    the score's scale and a threshold for each language. Without both classes the score is the constant share of toxic texts."""
    spare = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(5)) == 4
    found = {(r["spare"], r["y"]): r["n"] for r in rows.groupBy(spare.alias("spare"), "y").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (_, y), n in found.items() if y == v) for v in (0, 1)]
    if not all(total):
        net = _new_network(np.zeros(1 << bits), np.zeros(1 << bits), 0.5, bits)
        net.constant = total[1] / sum(total) if sum(total) else 0.0
        return net
    fit, held = (rows.filter(~spare), rows.filter(spare)) if len(found) == 4 else (rows, rows)
    n = [found[False, v] for v in (0, 1)] if len(found) == 4 else total
    positive, negative = _word_counts(fit, bits)
    net = _new_network(positive, negative, n[1] / sum(n), bits)
    # Only where the shift starts; it is learned with all the rest.
    first = _first_texts(fit, 200)
    net.out_bias = -float(np.median(net.logits(first, net.projected())))
    for _ in range(passes):
        net = _learned(net, fit, (sum(n) / (2 * n[0]), sum(n) / (2 * n[1])), rate)
    logits = stored(rows.sparkSession, _logits(net, held), "toxicity-logits")
    net.scale = _platt(logits)
    net.thresholds = _thresholds(logits, net.scale)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted`` (score of 0.5 or more) and ``flagged`` (by its language's threshold).

    Labels of ids whose CRC-32 is divisible by 5 are held out: they are never read for training. All others are learned from.
    Null labels count as no label, several labels of an id as toxic if one is, labels without a document are passed by. A score depends on the whole text only: null and
    empty texts are scored like any other, equal texts alike, and language, source and id are not looked at. Rows with
    equal or null ids each come out. Unknown languages have the threshold 0.5.
    """
    spark = docs.sparkSession
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (id_remainder(F.col("id")) != 0))
        .groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    )
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang"))
    # Merged at every size: the plan does not change where the labels outgrow a broadcast.
    model = spark.sparkContext.broadcast(train(stored(spark, texts.join(known.hint("merge"), "id").select("text", "y", "lang"), "labelled")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        table = net.projected()
        for batch in batches:
            found = batch.column(2).to_pylist()
            for i, j in slices(found, 400_000):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(net.scores(found[i:j], table), pa.float64()), batch.column(3)[i:j]],
                    names=["doc_id", "held_out", "score", "lang"])

    scored = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), (id_remainder(F.col(f"`{id_col}`")) == 0).alias("held_out"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang"),
    ).mapInArrow(score, "doc_id long, held_out boolean, score double, lang string")
    limit = F.lit(0.5)
    for name, value in model.value.thresholds.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
