"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner product is made least distance by one more component, the square root of what a vector's squared norm lacks
of the largest.  Distances are then projected by a Gaussian (2-stable) matrix: over the true squared distance, a squared
projected distance follows a chi-square distribution with as many degrees of freedom as there are projections.

* Equal vectors are one entry of the index with the least ids that an answer can need, merged map-side, so a vector that a
  third of all rows share is one entry.
* The upper kd-tree's splits come from a bounded sample (`sample` vectors); all vectors are indexed.  Its leaves hold the
  vectors, in as many shards as their counts ask for.
* Within a shard, the points of the kd-tree's buckets that the test does not rule out come in the order of their projected
  distance, and their vectors are verified by the full inner product.  The visit ends once a vector as near as the best so
  far would, with probability `certainty`, have been projected nearer than the next point.
* Round one searches a query's own leaf; what it finds is the bound with which round two searches every other leaf whose
  box the same test does not rule out.
* The certainty is the least that reaches a recall of `TARGET` on a bounded sample, on which the search is simulated.

The result says how many distinct vectors were verified for each query.  In 64 evenly used dimensions the search still
verifies a good part of all vectors, a smaller one the more there are; no projection tells near from far better there.

Defined results for odd input
* vectors that are null, zero, or hold a null or non-finite component take no part; nor do vectors of another length than
  the commonest (the longer of two equally common), nor rows with a null id;
* rows repeated with one id are one candidate, and each asks as a query of its own;
* ties go to the smaller id; fewer candidates than neighbours: all are returned; an empty table gives an empty result;
* other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, pieces

DIMENSIONS = 16  # even, for the closed form of the distribution
#: Recall that the simulation must reach, on so many vectors of the sample, for so many of them as queries.
TARGET = 0.93
TRIAL_ROWS, TRIAL_QUERIES = 4096, 128
CERTAINTIES = (0.5, 0.6, 0.7, 0.75, 0.8, 0.84, 0.87, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99, 0.995, 0.999)
SHARD_ROWS = 4096
BUCKET_ROWS = 32
#: Vectors that are verified between two tests.
STEP = 64
SAMPLE = 16384
SEED = 2024


def chi_square(x: np.ndarray, degrees: int = DIMENSIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term = total = np.ones_like(half)
    for j in range(1, degrees // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(certainty: float) -> float:
    """Where the distribution function reaches the certainty."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle)) < certainty else (low, middle)
    return high


@dataclass
class Space:
    """Vectors of one length, their largest squared norm, and the projection."""

    size: int
    most: float
    matrix: np.ndarray = field(init=False)

    def __post_init__(self):
        self.matrix = np.random.default_rng(SEED).standard_normal((self.size + 1, DIMENSIONS))

    def vectors(self, blobs) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, self.size)

    def project(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]


@dataclass
class Tree:
    """Upper splits: node i has children 2 i + 1 and 2 i + 2; leaves are numbered by the path to them."""

    depth: int
    axis: np.ndarray
    value: np.ndarray

    @classmethod
    def grown(cls, points: np.ndarray, depth: int) -> Tree:
        n = (1 << depth) - 1
        tree = cls(depth, np.zeros(n, int), np.zeros(n))
        parts = {0: points}
        for i in range(n):
            p = parts.pop(i, points[:0])
            if len(p):
                tree.axis[i] = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                tree.value[i] = float(np.median(p[:, tree.axis[i]]))
            right = p[:, tree.axis[i]] > tree.value[i]
            parts[2 * i + 1], parts[2 * i + 2] = p[~right], p[right]
        return tree

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def buckets(points: np.ndarray, most: int = BUCKET_ROWS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Leaves of a kd-tree over the points, with the corners of their boxes."""
    todo, done = [np.arange(len(points))], []
    while todo:
        i = todo.pop()
        if len(i) > most:
            p = points[i]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            order = np.argpartition(p[:, axis], len(i) // 2)
            todo += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
        else:
            done.append(i)
    return done, np.array([points[i].min(axis=0) for i in done]), np.array([points[i].max(axis=0) for i in done])


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


def answers(space: Space, x: np.ndarray, ids: list[list[int]], q: np.ndarray, known: np.ndarray, k: int, certainty: float) -> tuple[list[list[tuple[float, int]]], list[int]]:
    """For each query the best `k` (inner product, id) of a shard, and how many of its vectors were verified.

    `known` is the k-th best product found elsewhere.
    """
    points, targets = space.project(x), space.project(q, queries=True)
    groups, low, high = buckets(points)
    order = np.concatenate(groups)
    first = np.cumsum([0, *[len(g) for g in groups]])
    points, x, ids = points[order], x[order], [ids[i] for i in order]
    count, lead = np.array([len(i) for i in ids]), np.array([i[0] for i in ids])
    limit = quantile(certainty)
    out, verified = [], []
    for v, p, bound in zip(q, targets, known, strict=True):
        norm = float(v @ v) + space.most
        reach = limit * max(norm - 2 * bound, 1e-300) if bound > -np.inf else np.inf
        opened = np.flatnonzero(box_distance(p, low, high) <= reach)
        rows = np.concatenate([np.arange(first[g], first[g + 1]) for g in opened] or [np.zeros(0, int)])
        gap = points[rows] - p
        far = np.einsum("ij,ij->i", gap, gap)
        inside = far <= reach
        rows, far = rows[inside], far[inside]
        nearest_first = np.argsort(far, kind="stable")
        rows, far = rows[nearest_first], far[nearest_first]
        best_s, best_i, worst, at = np.zeros(0), np.zeros(0, int), bound, 0
        while at < len(rows) and far[at] <= reach:
            step = rows[at : at + STEP]
            at += len(step)
            s = x[step] @ v
            good = s >= worst
            if good.any():
                best_s, best_i = np.concatenate((best_s, s[good])), np.concatenate((best_i, step[good]))
                ranked = np.lexsort((lead[best_i], -best_s))
                # entries that hold k ids together, and those that tie with the last of them
                enough = int(np.searchsorted(np.cumsum(count[best_i[ranked]]), k)) + 1
                if enough <= len(ranked):
                    worst = max(worst, float(best_s[ranked[enough - 1]]))
                    ranked = ranked[best_s[ranked] >= worst]
                    reach = limit * max(norm - 2 * worst, 1e-300)
                best_s, best_i = best_s[ranked], best_i[ranked]
        found = sorted(((float(x[i] @ v), j) for i in best_i for j in ids[i]), key=lambda a: (-a[0], a[1]))
        out.append(found[:k])
        verified.append(at)
    return out, verified


def calibrated(space: Space, sample: np.ndarray, k: int, target: float = TARGET) -> float:
    """The least certainty with which a search of the sample finds so many of the nearest; the greatest where none does.

    The first vectors are searched for among all others.
    """
    x = sample[:TRIAL_ROWS]
    k = min(k, len(x) - 1)
    if k < 1:
        return CERTAINTIES[-1]
    points, q = space.project(x), x[:TRIAL_QUERIES]
    targets = space.project(q, queries=True)
    hits = np.zeros(len(CERTAINTIES))
    for i, (v, p) in enumerate(zip(q, targets, strict=True)):
        gap = points - p
        far, s = np.einsum("ij,ij->i", gap, gap), x @ v
        far[i], s[i] = np.inf, -np.inf
        order = np.argsort(far, kind="stable")[:-1]
        wanted = np.partition(s, -k)[-k]
        good = np.cumsum(s[order] >= wanted)
        stops = np.arange(k, len(order), STEP)
        kth = np.array([np.partition(s[order[:n]], n - k)[n - k] for n in stops])
        told = chi_square(far[order[stops]] / np.maximum(float(v @ v) + space.most - 2 * kth, 1e-300)) if len(stops) else np.zeros(0)
        for c, certainty in enumerate(CERTAINTIES):
            over = np.flatnonzero(told > certainty)
            n = stops[over[0]] if len(over) else len(order)
            hits[c] += min(1.0, good[n - 1] / k)
    enough = np.flatnonzero(hits >= target * len(q))
    return CERTAINTIES[int(enough[0])] if len(enough) else CERTAINTIES[-1]


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


FOUND = "vector binary, found array<struct<score:double,vec_id:long>>, verified long"


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", certainty: float | None = None, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score, verified``: for each row that `queries` (a condition on the input) picks, its `k`
    nearest by largest inner product in double precision among all other rows, and how many distinct vectors were verified.
    Without a given certainty it is calibrated on the sample."""
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = base.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id long, rank int, vec_id long, score double, verified long"
    if lengths is None:
        return spark.createDataFrame([], schema)
    size = int(lengths["n"])
    base = base.filter(F.size("v") == size)
    files = pieces(lengths["count"], 20_000)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vector, least ids) by distinct vector of the task, k + 1 ids at most; or (vector, one id) of each query."""
        kept: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.list_(pa.int64()))], names=["vector", "ids"])

        for batch in batches:
            flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), "<f8") + 0.0  # no negative zeros
            for i, v in zip(batch.column(0).to_pylist(), flat.reshape(-1, size), strict=True):
                mine = kept.setdefault(v.tobytes(), [])
                if i not in mine:
                    mine.append(i)
                    if len(mine) > k + 1:
                        mine.remove(max(mine))
            if len(kept) > 50_000:
                yield out()
                kept.clear()
        if kept:
            yield out()

    parts = base.select("vec_id", "v").mapInArrow(packed, "vector binary, ids array<long>")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    index = durable(parts.groupBy("vector").agg(merged.alias("ids")), files)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), "<f8") + 0.0
            blobs = [v.tobytes() for v in flat.reshape(-1, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["query_id", "vector"])

    asking = durable(base.filter("asks").select("vec_id", "v").mapInArrow(asked, "query_id long, vector binary"))

    norms = base.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    space = Space(size, float(norms) * (1 + 1e-12))
    n = index.count()
    chosen = index.select("vector").orderBy(F.xxhash64("vector")).limit(sample).collect()
    known_vectors = space.vectors([bytes(r[0]) for r in chosen])
    points = space.project(known_vectors)
    certainty = certainty or calibrated(space, known_vectors, k)
    depth = int(np.ceil(np.log2(max(1, min(n / shard_rows, len(points) / 16)))))
    tree = Tree.grown(points, depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = space.project(space.vectors(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf(p)), pa.array(list(p), pa.list_(pa.float64()))], names=["vector", "ids", "leaf", "p"])

    leaves = durable(index.mapInArrow(placed, "vector binary, ids array<long>, leaf long, p array<double>"))
    corners = [f(F.col("p")[d]).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(DIMENSIONS)]
    known = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *corners).orderBy("leaf").collect()  # 2 ** depth rows at most
    numbers = np.array([r["leaf"] for r in known])
    shards = {int(r["leaf"]): pieces(r["n"], shard_rows) for r in known}
    low, high = (np.array([[r[f"{c}{d}"] for d in range(DIMENSIONS)] for r in known]) for c in ("low", "high"))
    shard_of = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("leaf"))
    filed = leaves.select("vector", "ids", "leaf", F.pmod(F.xxhash64("vector"), shard_of).alias("shard"))

    limit = quantile(certainty)

    def routed(first: bool):
        """Where each distinct query goes: to its own leaf, then to all others that the test does not rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                blobs = batch.column(0).to_pylist()
                q = space.vectors(blobs)
                targets = space.project(q, queries=True)
                # a leaf without vectors holds no answer: the nearest box is then the query's own leaf
                for i, (blob, p, bound) in enumerate(zip(blobs, targets, batch.column(1).to_pylist(), strict=True)):
                    near = box_distance(p, low, high)
                    own = int(near.argmin())
                    if first:
                        go = [own]
                    else:
                        scale = max(float(q[i] @ q[i]) + space.most - 2 * bound, 1e-300) if bound is not None else np.inf
                        go = [j for j in np.flatnonzero(near <= limit * scale) if j != own]
                    for j in go:
                        for s in range(shards[int(numbers[j])]):
                            for column, value in zip(out, (blob, -np.inf if bound is None else bound, int(numbers[j]), s), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["vector", "bound", "leaf", "shard"])

        return run

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"vector": [], "found": [], "verified": []}, dtype=object)
        ids = [sorted(int(i) for i in x) for x in mine["ids"]]
        got, verified = answers(space, space.vectors(mine["vector"]), ids, space.vectors(theirs["vector"]), theirs["bound"].to_numpy(float), k + 1, certainty)
        return pd.DataFrame({"vector": theirs["vector"].to_list(), "found": [[{"score": s, "vec_id": i} for s, i in x] for x in got], "verified": verified})

    def searched(places: DataFrame) -> DataFrame:
        return filed.groupBy("leaf", "shard").cogroup(places.groupBy("leaf", "shard")).applyInPandas(search, FOUND)

    def best(found: DataFrame) -> DataFrame:
        """The k + 1 best of each query; a query has at most that many from every shard it was sent to."""
        order = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("i"))))
        return found.groupBy("vector").agg(F.slice(order, 1, k + 1).alias("found"), F.sum("verified").alias("verified"))

    distinct = asking.select("vector").distinct().withColumn("bound", F.lit(None).cast("double"))
    way = "vector binary, bound double, leaf long, shard long"
    one = durable(searched(distinct.mapInArrow(routed(True), way)))
    bounds = best(one).select("vector", F.when(F.size("found") > k, -F.element_at("found", k + 1)["s"]).alias("bound"))
    two = searched(bounds.mapInArrow(routed(False), way))
    every = best(one.union(two))
    others = F.slice(F.filter("found", lambda x: x["i"] != F.col("query_id")), 1, k)
    listed = asking.join(every, "vector").select("query_id", "verified", F.posexplode(others).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"), "verified")
