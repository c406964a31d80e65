"""Vector codes: integer codebooks by part, with nearest entries found through a geometric near-neighbour access tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import stored

#: Whole numbers up to this stay exact in squared distances of 64-bit integers; larger ones are handled as Python's.
_SMALL = 1 << 26
#: Rounding of a square root and of the number it is taken from, with room to spare.
_DOWN, _UP = 1 - 2.0**-50, 1 + 2.0**-50


def _squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = points - to
    return (gap * gap).sum(axis=1)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * _DOWN


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * _UP


class Gnat:
    """Nearest entry of an integer codebook, ties to the lower number.

    A node has some entries as split points; every other entry of the node goes to the subtree of the nearest one. For
    each pair of split point and subtree the node keeps the least and largest distance between them. A query's distance to
    a split point rules a subtree out when even the nearest distance that the triangle inequality allows is more than the best so far: strictly
    more, by roots rounded outwards, so an equally near entry is never lost. Which entry is nearest is told by integers alone.
    """

    def __init__(self, entries: np.ndarray, degree: int = 4):
        self.entries = entries
        self.compared = 0
        self.root = self._node(list(range(len(entries))), degree) if len(entries) else None

    def _node(self, members: list[int], degree: int) -> dict:
        splits, rest = [members[0]], members[1:]
        near = _squared(self.entries[rest], self.entries[splits[0]]) if rest else None
        while rest and len(splits) < degree:
            at = int(np.argmax(near))
            splits.append(rest.pop(at))
            near = np.delete(near, at)
            if rest:
                near = np.minimum(near, _squared(self.entries[rest], self.entries[splits[-1]]))
        owned: list[list[int]] = [[] for _ in splits]
        for x in rest:
            owned[int(np.argmin(_squared(self.entries[splits], self.entries[x])))].append(x)
        m = len(splits)
        low, high = np.zeros((m, m)), np.zeros((m, m))
        for i, s in enumerate(splits):
            for j, t in enumerate(splits):
                gaps = _squared(self.entries[[t, *owned[j]]], self.entries[s])
                low[i, j], high[i, j] = _root_down(gaps).min(), _root_up(gaps).max()
        return {"splits": splits, "low": low, "high": high, "below": [self._node(x, degree) if x else None for x in owned]}

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and squared distance to it, for each row of ``points``."""
        best = np.full(len(points), len(self.entries), dtype=np.int64)
        gap = np.full(len(points), -1, dtype=points.dtype)
        if len(points):
            self._visit(self.root, points, np.arange(len(points)), best, gap)
        return best, gap

    def _visit(self, node: dict, points: np.ndarray, rows: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        splits, m = node["splits"], len(node["splits"])
        alive = np.ones((len(rows), m), dtype=bool)
        near, far = np.full((len(rows), m), np.nan), np.full((len(rows), m), np.nan)
        for i, entry in enumerate(splits):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            ids = rows[at]
            squared = _squared(points[ids], self.entries[entry])
            self.compared += len(at)
            better = (best[ids] == len(self.entries)) | (squared < gap[ids]) | ((squared == gap[ids]) & (entry < best[ids]))
            best[ids[better]], gap[ids[better]] = entry, squared[better]
            near[at, i], far[at, i] = _root_down(squared), _root_up(squared)
            alive[at] &= ~self._out(node, i, near[at, i], far[at, i], _root_up(gap[ids]), keep=i)
        for j, below in enumerate(node["below"]):
            at = np.flatnonzero(alive[:, j]) if below else np.array([], dtype=np.int64)
            for i in range(m):  # the best may have come nearer since
                at = at[np.isnan(near[at, i]) | ~self._out(node, i, near[at, i], far[at, i], _root_up(gap[rows[at]]))[:, j]]
            if len(at):
                self._visit(below, points, rows[at], best, gap)

    @staticmethod
    def _out(node: dict, i: int, near: np.ndarray, far: np.ndarray, reach: np.ndarray, keep: int | None = None) -> np.ndarray:
        """Which subtrees a distance between ``near`` and ``far`` to split point ``i`` rules out."""
        out = ((near * _DOWN)[:, None] > (node["high"][i][None, :] + reach[:, None]) * _UP) | (((far + reach) * _UP)[:, None] < (node["low"][i] * _DOWN)[None, :])
        if keep is not None:
            out[:, keep] = False
        return out


def _as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` whole numbers; Python's own where 64 bits might not hold a squared distance."""
    out = np.asarray(column.flatten()).reshape(-1, dim)
    return out if not out.size or max(int(out.max()), -int(out.min())) <= _SMALL else out.astype(object)


def _trees(books: list[np.ndarray]) -> list[Gnat]:
    return [Gnat(b) for b in books]


def _common(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return points if points.dtype == entries.dtype else points.astype(object)


def _entries(rows: list[list[int]], parts: int) -> list[np.ndarray]:
    whole = np.array(rows, dtype=object).reshape(len(rows), -1)
    if whole.size and max(abs(x) for x in whole.flat) <= _SMALL:
        whole = whole.astype(np.int64)
    return np.split(whole, parts, axis=1)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors and the codebooks behind them.

    Each component becomes ``floor(scale * x)``; vectors are cut into ``parts`` equal parts with a codebook each, of at most 256
    ``entries``. A codebook starts as that part of the vectors with the smallest ids (equal ids: smaller vectors first; null ids last). A round gives each part
    to the nearest entry and replaces every used entry by the floored mean of its parts; after the last round parts are given out again.

    Result per vector: ``vec_id``, ``label``, ``code`` (two hex digits a part), ``error`` (squared distance, null if no long holds it). Vectors that are null, or hold a
    null, non-finite or (beyond 2**62 after scaling) unstorable component are left out. Vectors of another length than that of the smallest id, or
    one that ``parts`` does not divide, have a null code and error. An empty table gives an empty one and no codebooks. Rows with
    equal ids each come out.

    A round is one pass over the stored integers: tasks send one sum a used entry and component, which Spark adds up; the driver sees
    ``entries`` times the dimension of these sums, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    limit = float(2**62 // scale)
    usable = F.coalesce(F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit), F.lit(False))), F.lit(False))
    rows = vectors.filter(usable).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    whole = stored(spark, rows, "scaled")
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = whole.orderBy(*by_id).select(F.size("v").alias("d")).limit(1).collect()
    dim = int(first[0]["d"]) if first else 0
    fits = F.size("v") == dim if dim and dim % parts == 0 else F.lit(False)
    able = whole.filter(fits)
    seeds = [r["v"] for r in able.orderBy(*by_id).select("v").limit(entries).collect()]
    books = _entries(seeds, parts) if seeds else []
    width = dim // parts

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, n, sums = _trees(books), {}, {}
        for batch in batches:
            points = _as_matrix(batch.column(0), dim)
            exact = points.dtype != object and len(points) * _SMALL < 1 << 62
            for p, tree in enumerate(trees):
                part = points[:, p * width : (p + 1) * width]
                near, _ = tree.nearest(_common(part, tree.entries))
                for e in np.unique(near).tolist():
                    mine = part[near == e]
                    own = (mine if exact else mine.astype(object)).sum(axis=0).tolist()
                    n[p, e] = n.get((p, e), 0) + len(mine)
                    sums[p, e] = [a + b for a, b in zip(sums.get((p, e), [0] * width), own)]
        out = [(p, e, i, Decimal(x), n[p, e]) for (p, e), xs in sums.items() for i, x in enumerate(xs)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "entry", "at", "total", "n"])

    for _ in range(rounds if books else 0):
        sums = able.select("v").mapInArrow(total, "part int, entry int, at int, total decimal(38,0), n long")
        new = [b.astype(object).tolist() for b in books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // int(r["n"])
        books = _entries([sum((new[p][e] for p in range(parts)), []) for e in range(len(seeds))], parts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            points = _as_matrix(batch.column(1), dim)
            found = [t.nearest(_common(points[:, p * width : (p + 1) * width], t.entries)) for p, t in enumerate(trees)]
            digits = np.stack([near for near, _ in found], axis=1).astype(np.uint8)
            errors = sum(gap.astype(object) for _, gap in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes().hex() for x in digits], pa.string()), pa.array([x if x < 1 << 63 else None for x in errors], pa.int64())],
                names=["row", "code", "error"])

    if not books:
        return whole.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    coded = able.select(F.struct("vec_id", "label").alias("row"), "v").mapInArrow(code, f"row struct<vec_id:bigint,label:{whole.schema['label'].dataType.simpleString()}>, code string, error long")
    out = coded.select("row.vec_id", "row.label", "code", "error")
    return out.unionByName(whole.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame, **options) -> DataFrame:
    """``compress`` with, per vector, the sum of errors over its label (null labels together) and the digest of the codebooks."""
    coded, books = compress(vectors, **options)
    rows = stored(vectors.sparkSession, coded, "codes")
    sums = rows.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
