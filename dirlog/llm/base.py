"""Helpers shared by the operators: shared storage, batches of text, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlog.session import stored

__all__ = ["Forest", "bounded", "components", "sized", "spanning", "stored", "table"]


#: Bytes of a batch that Spark hands to Python at most, unless a single row is longer.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, of whose rows Python workers get a few MB at once, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(texts: list, limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters each, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


class Forest:
    """Union-find over the positions of one block of rows; keeps only the links that unite."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the undirected graph whose adjacency is the boolean matrix ``linked``.

    A row is visited once, so a block of n rows gives n - 1 edges at most, however many pairs are linked.
    """
    out: list[tuple[int, int]] = []
    left = linked.any(axis=1)
    while left.any():
        seed = int(left.argmax())
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, int(j)) for j in new]
            queue += new.tolist()
    return out


#: Edges that a task reduces to a forest at once, and tasks at least.
FOREST_EDGES, FOREST_TASKS = 500_000, 8


def forests(pairs: DataFrame, n: int) -> DataFrame:
    """Of n edges (u, v) as many as keep connected what they connect: each task leaves a spanning forest of its own.

    A large group with many links among its members goes on with a few edges a member.
    """

    def reduce(batches):
        for rows in batches:
            ids, at = np.unique(np.concatenate((np.asarray(rows.column(0)), np.asarray(rows.column(1)))), return_inverse=True)
            forest, m = Forest(len(ids)), rows.num_rows
            keep = [forest.unite(a, b) for a, b in zip(at[:m].tolist(), at[m:].tolist())]
            yield rows.filter(pa.array(keep, pa.bool_()))

    def whole(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from reduce([pa.Table.from_batches(held).combine_chunks().to_batches()[0]])

    return pairs.repartition(max(FOREST_TASKS, -(-n // FOREST_EDGES))).mapInArrow(whole, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (u long, v long), any direction, repeats allowed. Returns (id, component_id): every id of an
    edge with the smallest id that it reaches. Each round is two partial aggregations (the smallest
    neighbour) and two joins that adaptive execution can split; rounds grow with the logarithm of the
    longest path. The state of a round is written to the shared folder.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = stored(pairs)
    pairs, before = stored(forests(pairs, pairs.count())), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = stored(small.distinct())
        state = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(u % 1000003)")).first()
        if state == before:
            break
        before = state
    return pairs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
