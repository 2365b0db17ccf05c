"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id, a shard holding about ``SHARD_ROWS`` vectors whatever their number.
In a shard, a tree splits at the median of the widest side until a leaf holds ``LEAF`` vectors at most; every node keeps
the tight box of what is below it. The best inner product that a box can hold with a query is the sum over components
of the larger of q * low and q * high. A query visits nodes best bound first and stops when the best bound left is
below its k-th score so far.

Queries go to the shards in blocks of ``QUERY_BLOCK``, so a task holds one shard and one block at a time. The search
has two passes: the first covers a small part of the shards and gives every query a k-th score; the second starts all
other shards from that score, so a shard returns only what may still enter the result.

Defined results: components are floor(scale * x) with x as a double, and saturate at the limits of a 64-bit integer, as
do scores; sums are exact (floating-point where that is exact, integers of any size else). Rows with a null id and vectors
that are null or hold null or non-finite components take no part. Vectors are compared with those of their own length. A query is compared with
all rows but those of its own id; repeated rows of other ids count each. Ties go to the smaller id. An empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow import workers
from ebbflow.llm import support

SHARD_ROWS, LEAST_SHARDS, LEAF, QUERY_BLOCK = 8192, 16, 128, 4096
#: One in so many shards belongs to the first pass.
FIRST_PASS = 16
EXACT = 2**53
LOW, HIGH = -(2**63), 2**63 - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with integer components; only vectors that take part."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(good)
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Tree:
    """A KD-tree over the rows of ``vectors``; nodes are numbered, ``children`` is (-1, -1) for leaves."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(np.arange(len(vectors)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.rows)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            own = vectors[rows]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.children.append((-1, -1))
            widest = high[-1] - low[-1]
            if len(rows) <= leaf or not len(widest) or not widest.max() > 0:
                self.rows.append(rows)
                continue
            self.rows.append(rows[:0])
            axis = int(np.argmax(widest))
            order = rows[np.argsort(own[:, axis], kind="stable")]
            half = len(order) // 2
            todo += [(order[half:], node, 1), (order[:half], node, 0)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best product of each query (row) with anything in each node (column)."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ self.high.T + minus @ self.low.T


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, bounds: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard that reach ``floor``, best first."""
    best: list[tuple[int, int]] = []  # a heap of (score, -id): its head is what the next better row replaces
    heap = [(-bounds[0], 0)]
    least = -math.inf if floor is None else floor
    while heap and -heap[0][0] >= least:
        node = heapq.heappop(heap)[1]
        a, b = tree.children[node]
        if a >= 0:
            for child in (a, b):
                if bounds[child] >= least:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        rows = tree.rows[node]
        scores = vectors[rows] @ query
        for i in np.flatnonzero(scores >= least).tolist():
            other = int(ids[rows[i]])
            if other == query_id:
                continue
            entry = (int(scores[i]), -other)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
            if len(best) == k:
                least = max(least, best[0][0])
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _search_shard(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            v, q = np.stack(rows["v"].to_numpy()), np.stack(queries["q"].to_numpy())
            reach = v.shape[1] * max(map(abs, (int(v.min(initial=0)), int(v.max(initial=0))))) * max(map(abs, (int(q.min(initial=0)), int(q.max(initial=0)))))
            kind = float if reach < EXACT else object
            v, q, ids = v.astype(kind), q.astype(kind), rows["vec_id"].to_numpy()
            tree = Tree(v)
            bounds = tree.bounds(q)
            for i, (query_id, floor) in enumerate(zip(queries["query_id"].tolist(), queries["floor"].tolist())):
                for score, other in search(tree, v, ids, q[i], query_id, bounds[i], k, None if pd.isna(floor) else int(floor)):
                    out["query_id"].append(query_id)
                    out["vec_id"].append(other)
                    out["score"].append(min(max(score, LOW), HIGH))
        return pd.DataFrame(out)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` that ``is_query`` (on vec_id) picks."""
    spark = vectors.sparkSession
    workers.reach(spark)
    rows = support.checkpoint(quantized(vectors, id_col, vector_col, scale))
    n, wanted = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(wanted / QUERY_BLOCK))
    first = math.ceil(shards / FIRST_PASS)
    dealt = rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64(F.lit(41), "vec_id"), F.lit(shards)))
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(43), "vec_id"), F.lit(blocks)).alias("block"))
    group = ("shard", "block", "dim")

    def run(low: int, high: int, queries: DataFrame) -> DataFrame:
        here = dealt.filter(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1)).cast("array<bigint>")))
        both = here.select(*group, "vec_id", "v").groupBy(*group).cogroup(sent.select(*group, "query_id", "q", "floor").groupBy(*group))
        return both.applyInPandas(_search_shard(k), "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    seen = support.checkpoint(best(run(0, first, asked.withColumn("floor", F.lit(None).cast("bigint")))))
    kth = seen.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    more = run(first, shards, asked.join(kth, "query_id", "left"))
    return best(seen.drop("rank").union(more)).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    return top_k(support.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
