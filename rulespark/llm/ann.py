"""Operator 4: nearest neighbours by collision counting (query-aware hashing).

Every vector is projected on ``PROJECTIONS`` random directions; each projection of a block
of vectors is one sorted array. A query looks at a window centred on its own projection in
each array; a vector that lies in at least ``threshold`` of the windows is verified by its
true distance. Virtual rehashing widens all windows by a factor at a time, and only the new
ends of a window are counted. The search of a block ends when a vector as near as the
query's k-th best so far would, with probability ``SURE``, have reached the threshold already:
so the number of candidates is not capped, and dense neighbourhoods are verified whole. A block
searched after others starts with the window that the k-th best so far asks for, which is one round.

The index is built over all vectors, in blocks of bounded size that stay where they are
read. Queries are a stated set; they go to the blocks in groups of at most ``QUERIES``
vectors, which bounds what is broadcast, and each task returns its best k for each query.
Each query passes each block: with queries a fixed share of the rows the work grows with the
square of the table, as for any search of a stated query set in blocks. Windows of a neighbour's
width cover much of each projection where vectors have many independent dimensions, so dealing
(query, vector) collisions over the cluster would move more rows than the blocks have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, materialize

PROJECTIONS = 48
#: Collisions that make a vector a candidate, as a share of the projections.
SHARE = 0.7
#: Growth of the windows from one round of virtual rehashing to the next.
GROWTH = 1.25
#: Chance that a vector as near as the k-th best has been verified.
SURE = 0.97
#: Vectors in one block.
BLOCK = 8192
#: Queries in one group.
QUERIES = 4096
SEED = 7

INDEXED = "id long, v array<double>"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & v.isNotNull())
        .where(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    )


def directions(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, PROJECTIONS))


@lru_cache(maxsize=1)
def reach() -> float:
    """The half window, in units of distance, at which a vector reaches the threshold with
    probability ``SURE``: its projections' differences are normal with its distance as deviation."""
    need = threshold()
    low, high = 0.01, 10.0
    for _ in range(60):
        half = (low + high) / 2
        p = erf(half / sqrt(2))
        tail, term = 0.0, (1 - p) ** PROJECTIONS
        for k in range(PROJECTIONS + 1):
            if k >= need:
                tail += term
            if p < 1:
                term *= (PROJECTIONS - k) / (k + 1) * p / (1 - p)
        low, high = (low, half) if tail >= SURE else (half, high)
    return high


def threshold() -> int:
    return int(np.ceil(SHARE * PROJECTIONS))


class Block:
    """The sorted arrays of up to ``BLOCK`` vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, along: np.ndarray):
        self.ids, self.vectors = ids, vectors
        projected = vectors @ along
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        # One array for all projections: each has its own range of values, so one search serves all.
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]
        self.shift = np.arange(PROJECTIONS) * (2 * float(self.high.max() - self.low.min()) + 1)
        self.first = np.arange(PROJECTIONS) * len(ids)
        self.flat = (self.sorted + self.shift[:, None]).ravel()

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each projection, the places in its sorted array of what lies within ``half`` of ``at``."""
        low = np.searchsorted(self.flat, np.clip(at - half, self.low, self.high) + self.shift, "left")
        high = np.searchsorted(self.flat, np.clip(at + half, self.low, self.high) + self.shift, "right")
        # A window that ends before the first value or begins after the last holds nothing.
        high = np.where(at + half < self.low, low, high)
        return np.where(at - half > self.high, high, low) - self.first, high - self.first

    def search(self, query_id: int, query: np.ndarray, at: np.ndarray, first: float, best: list[tuple[float, int]], k: int) -> None:
        """Adds to ``best`` (distance, id), sorted, of at most ``k``. ``first``: the first half window,
        unless ``best`` is full: then the search starts at what its k-th asks for."""
        n = len(self.ids)
        counts = np.zeros(n, np.int16)
        pending = np.ones(n, bool)
        half, need = max(first, 1e-12), threshold()
        if len(best) == k:
            half = max(reach() * best[-1][0], 1e-12)
        left = right = None
        while True:
            low, high = self.windows(at, half)
            if left is None:
                left = right = low
            low, high = np.minimum(low, left), np.maximum(high, right)
            pairs = ((j, a, b) for j in range(PROJECTIONS) for a, b in ((low[j], left[j]), (right[j], high[j])) if a < b)
            ends = [self.order[j, a:b] for j, a, b in pairs]
            left, right = low, high
            if ends:
                counts += np.bincount(np.concatenate(ends), minlength=n).astype(np.int16)
            found = np.flatnonzero(pending & (counts >= need))
            if len(found):
                pending[found] = False
                gap = self.vectors[found] - query
                distance = np.sqrt((gap * gap).sum(axis=1))
                other = self.ids[found] != query_id
                ids, distance = self.ids[found][other], distance[other]
                if len(best) == k:
                    near = distance <= best[-1][0]
                    ids, distance = ids[near], distance[near]
                nearest = np.lexsort((ids, distance))[:k]
                best.extend(zip(distance[nearest].tolist(), ids[nearest].tolist(), strict=True))
                best.sort()
                del best[k:]
            if (right - left).min() == n or len(best) == k and half >= reach() * best[-1][0]:
                return
            half *= GROWTH
            if len(best) == k:  # no wider than the k-th best asks for
                half = min(half, max(reach() * best[-1][0], half / GROWTH))


def _first_half(block: Block) -> float:
    """A first window: a fiftieth of the spread of the projections."""
    spread = float((block.sorted[:, -1] - block.sorted[:, 0]).mean())
    return max(spread / 50, 1e-12)


def _group(rows: list, dimensions: int) -> dict:
    along = directions(dimensions)
    vectors = np.array([r["v"] for r in rows], np.float64)
    return {"ids": [r["id"] for r in rows], "vectors": vectors, "at": vectors @ along, "along": along}


def nearest(vectors: DataFrame, key: str, vector: str, queries, k: int = 10, group: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest of every query: query_id, rank, <key>, score (Euclidean distance).

    ``queries`` is a condition on ``id``; every other vector is a candidate. Vectors that are
    null, zero or hold a null or non-finite component take no part, nor do null ids; vectors
    of another length than a query's are no candidates of it. Ties go to the smaller id; rows
    that repeat an id are candidates of each other's queries only under other ids, and such a
    query is answered once. A table without queries gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    rows = materialize(usable(vectors, key, vector), "vectors")
    asked = materialize(
        rows.where(queries).groupBy("id", F.size("v").alias("d")).agg(F.min("v").alias("v")), "queries"
    )
    sizes = asked.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()

    found = []
    for size in sizes:
        parts = -(-size["n"] // group)
        same = rows.where(F.size("v") == size["d"])
        for g in range(parts):
            own = asked.where((F.col("d") == size["d"]) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == g))
            held = spark.sparkContext.broadcast(_group(own.collect(), size["d"]))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                asked = held.value
                best: list[list[tuple[float, int]]] = [[] for _ in asked["ids"]]

                def work(ids: list[np.ndarray], parts: list[np.ndarray]) -> None:
                    made = Block(np.concatenate(ids), np.concatenate(parts), asked["along"])
                    first = _first_half(made)
                    for i, query in enumerate(asked["ids"]):
                        made.search(query, asked["vectors"][i], asked["at"][i], first, best[i], k)

                ids, parts, n = [], [], 0
                for batch in batches:
                    ids.append(batch.column(0).to_numpy())
                    flat = batch.column(1).flatten().to_numpy()
                    parts.append(flat.reshape(len(ids[-1]), -1))
                    n += len(ids[-1])
                    if n >= block:
                        work(ids, parts)
                        ids, parts, n = [], [], 0
                if n:
                    work(ids, parts)
                out = [(q, i, s) for q, own in zip(asked["ids"], best, strict=True) for s, i in own]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    ["query_id", "found", "score"],
                )

            found.append(same.mapInArrow(run, "query_id long, found long, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "found")
    every = reduce(DataFrame.union, found).groupBy("query_id", "found").agg(F.min("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(key), "score")
