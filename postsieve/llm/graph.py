"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import stored


class Forest:
    """Union-find over the numbers 0 .. n - 1; the smallest number of a tree is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)


def components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per id in ``links``: ``id`` and ``component``, the smallest id that its links reach. Nulls link nothing.

    Each round takes the smallest id among the neighbours, then that of that one, and goes on with the graph of what was joined, so both
    chains and dense groups shrink fast. Every round is a stored table: the driver only asks whether links are left, and the links of an id that very many
    others link to are joined from stored sides, which lets Spark split them over tasks.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = stored(spark, pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    whole = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
        over = low.select(F.col("id").alias("via"), F.col("label").alias("further"))
        labels = stored(spark, low.join(over, low["label"] == over["via"]).select("id", F.col("further").alias("label")), "labels")
        if whole is None:
            whole = labels.withColumnRenamed("label", "component")
        else:
            moved = labels.select(F.col("id").alias("was"), "label")
            whole = stored(spark, whole.join(moved, whole["component"] == moved["was"], "left").select("id", F.coalesce("label", "component").alias("component")), "components")
        of_a, of_b = labels.select(F.col("id").alias("a"), F.col("label").alias("x")), labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
        joined = edges.join(of_a, "a").join(of_b, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edges = stored(spark, joined.distinct(), "links")
        if edges.isEmpty():
            return whole
