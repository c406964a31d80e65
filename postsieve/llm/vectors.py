"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual codes, table lookups, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import stored
from postsieve.llm.graph import components


def _kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a seeded choice of distinct points."""
    random = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[random.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(points, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each point, nearest first."""
    gap = (centres**2).sum(1) - 2 * points @ centres.T
    return np.argsort(gap, axis=1, kind="stable")[:, :n]


@dataclass
class Quantiser:
    """Coarse centres, and for each subspace a codebook of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    bounds: list[tuple[int, int]]

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int, subspaces: int, codes: int, rounds: int = 8) -> Quantiser:
        centres = _kmeans(unit, lists, rounds, 1)
        rest = unit - centres[_nearest(unit, centres, 1)[:, 0]]
        cuts = np.linspace(0, unit.shape[1], min(subspaces, unit.shape[1]) + 1).astype(int)
        bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return cls(centres, [_kmeans(rest[:, a:b], codes, rounds, 2) for a, b in bounds], bounds)

    def encode(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each vector's residual, and how far the decoded vector is from the true one."""
        rest = unit - self.centres[own]
        codes = np.stack([_nearest(rest[:, a:b], book, 1)[:, 0] for (a, b), book in zip(self.bounds, self.books)], axis=1)
        decoded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - decoded) ** 2).sum(1))

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the decoded vectors of list ``at``, each the sum of one table entry for a subspace."""
        rest = queries - self.centres[at]
        total = np.zeros((len(queries), len(codes)))
        for m, ((a, b), book) in enumerate(zip(self.bounds, self.books)):
            q = rest[:, a:b]
            table = (q**2).sum(1)[:, None] - 2 * q @ book.T + (book**2).sum(1)
            total += table[:, codes[:, m]]
        return np.maximum(total, 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    out = np.array(vectors.tolist(), dtype=np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, lists: int = 256, probes: int = 12, subspaces: int = 8, codes: int = 64,
                 sample_rows: int = 20_000, block_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id`` and ``kept`` (whether it is the first of its component).

    Vectors of one label and dimension link when their cosine in double precision is at least ``threshold``. Null, zero and
    non-finite vectors, null labels and null ids link with nothing and are their own component. Rows with one id count once as a partner;
    each row comes out. Equal vectors are searched once, with their number. An empty table gives an empty table.

    Centres and codebooks are fitted on ``sample_rows`` vectors chosen by the hash of their id; every vector is indexed in its
    nearest list and asks ``probes`` lists. The table distance to a decoded vector is compared with the link distance plus
    that vector's own coding error, so the lookup loses nothing; a pair is missed only if neither vector's list is among the other's probes.
    Tasks take blocks of a list's queries against blocks of its vectors, give counts and trees, never
    pairs; so a list with a third of all rows is spread over many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    whole = "label IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    able = F.coalesce(F.expr(whole), F.lit(False))
    distinct = rows.filter(able).distinct().groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = stored(spark, distinct, "vectors")

    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toPandas()
    models: dict[int, Quantiser] = {}
    for size, some in sample.groupby(sample["v"].map(len)):
        models[int(size)] = Quantiser.fit(_unit(some["v"]), min(lists, max(1, len(some) // 20)), subspaces, codes)

    def model(size: int) -> Quantiser:
        return models.get(size) or Quantiser(np.zeros((1, size)), [np.zeros((1, size))], [(0, size)])

    def assign(batches):
        for batch in batches:
            for size, some in batch.groupby(batch["v"].map(len)):
                with_, unit = model(int(size)), _unit(some["v"])
                near = _nearest(unit, with_.centres, probes)
                found, error = with_.encode(unit, near[:, 0])
                yield pd.DataFrame({
                    "label": some["label"], "size": int(size), "rep": some["rep"], "copies": some["copies"], "own": near[:, 0], "probes": list(near),
                    "codes": list(found), "error": error, "unit": list(unit),
                })

    coded = stored(spark, reps.mapInPandas(
        assign, "label string, size int, rep long, copies long, own int, probes array<int>, codes array<int>, error double, unit array<double>"), "coded")
    place = ["label", "size", "list"]
    held = coded.groupBy("label", "size", F.col("own").alias("list")).agg(F.count("*").alias("n"))
    asked = coded.select("label", "size", F.explode("probes").alias("list")).groupBy(*place).agg(F.count("*").alias("q"))
    parts = stored(spark, held.join(asked, place).select(
        *place, F.ceil(F.col("n") / block_rows).cast("int").alias("ny"), F.ceil(F.col("q") / block_rows).cast("int").alias("nq")), "lists")
    salt = F.xxhash64("rep")
    base = coded.withColumn("list", F.col("own")).join(parts, place).withColumn("yb", F.pmod(salt, "ny")).withColumn("qb", F.explode(F.expr("sequence(0L, nq - 1L)")))
    asks = coded.withColumn("list", F.explode("probes")).join(parts, place).withColumn("qb", F.pmod(salt, "nq")).withColumn("yb", F.explode(F.expr("sequence(0L, ny - 1L)")))
    columns = [*place, "yb", "qb", "asks", "rep", "copies", "own", "probes", "codes", "error", "unit"]
    dealt = base.withColumn("asks", F.lit(False)).select(columns).unionByName(asks.withColumn("asks", F.lit(True)).select(columns))
    reach = np.sqrt(2 - 2 * threshold) + 1e-9

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        y, q = group[~group["asks"]], group[group["asks"]]
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if y.empty or q.empty:
            return empty
        at, with_ = int(key[2]), model(int(key[1]))
        a, b = np.array(q["unit"].tolist()), np.array(y["unit"].tolist())
        far = with_.distances(a, at, np.array(y["codes"].tolist()))
        near = np.sqrt(far) <= reach + y["error"].to_numpy()
        qi, yi = q["rep"].to_numpy(), y["rep"].to_numpy()
        near &= qi[:, None] != yi[None, :]
        asking, asked_ = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(asking):
            return empty
        near = near[np.ix_(asking, asked_)] & (a[asking] @ b[asked_].T >= threshold)
        qi, yi, q, y = qi[asking], yi[asked_], q.iloc[asking], y.iloc[asked_]
        # A vector that does not itself ask the list of its partner gets the partner's link here.
        asks_back = (np.array(y["probes"].tolist())[:, None, :] == q["own"].to_numpy()[None, :, None]).any(2).T
        to_q = near @ y["copies"].to_numpy()
        to_y = (near & ~asks_back).T @ q["copies"].to_numpy()
        none = np.iinfo(np.int64).max
        root_q, root_y = qi.copy(), yi.copy()
        while True:
            low_q = np.minimum(root_q, np.where(near, root_y[None, :], none).min(1))
            low_y = np.minimum(root_y, np.where(near, low_q[:, None], none).min(0))
            if (low_q == root_q).all() and (low_y == root_y).all():
                break
            root_q, root_y = low_q, low_y
        out = pd.DataFrame({"id": np.concatenate([qi, yi]), "links": np.concatenate([to_q, to_y]), "root": np.concatenate([root_q, root_y])})
        return out[(out["links"] > 0) | (out["root"] != out["id"])]

    found = stored(spark, dealt.groupBy(*place, "yb", "qb").applyInPandas(search, "id long, links long, root long"), "found")
    counts = stored(spark, found.groupBy("id").agg(F.sum("links").alias("links")), "counts").withColumnRenamed("id", "rep")
    trees = components(spark, found, "id", "root").withColumnRenamed("id", "rep")
    summed = stored(spark, reps.join(counts, "rep", "left").join(trees, "rep", "left").select(
        "label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "summed")
    key = F.when(able, F.col("v"))
    out = rows.withColumn("v", key).join(summed, ["label", "v"], "left").select(
        F.col("id").alias("vec_id"), F.when(able, F.col("n_links")).alias("n_links"), F.when(able, F.col("component")).alias("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
