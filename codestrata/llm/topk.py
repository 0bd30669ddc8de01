"""Exact top-k by inner product, by aggregation of sorted lists without random access.

Method: vectors are integers (floor(256 * x)). In a block of candidates every dimension is a list of its entries sorted by component. A query reads each list from the end
where its own component makes the largest products, in segments and never at random. What is read of a vector counts as it is; what isn't read of it is at
best the entry at the front of that list and at worst the one at its end, which bounds the vector's score from above and below. The k-th best lower bound (or what earlier
blocks gave, if that is more) is the floor; a query stops reading as soon as no more than ``RESOLVE`` vectors reach it with their upper bounds, so that
no other can qualify, and only these are resolved exactly. A block is left unread if even the heads of all its lists stay below the floor.

The bounds of all queries of a block at one depth are matrix products: positive components meet the lists read from the top, negative ones those read from the bottom.

Scale: candidates are cut into blocks once and never shuffled; vectors of a neighbourhood share a block, so that whole blocks fall at the heads. Queries go to them
in stages of ``STAGE_BYTES`` at most, which are broadcast; each stage's k rows a query and task are written to the shared folder before the next one. The stages are as many as it takes for
all queries, so the work is the number of pairs, but shuffled are only k rows a query and task.

Edge cases: null vectors and vectors with null or non-finite components take no part, nor do rows without id; of rows that repeat an id
the smallest vector counts; vectors meet only those of their own length; empty vectors score 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shared_dir

K, EVERY, SCALE = 5, 50, 256
QUERY_BLOCK, BLOCK = 1024, 2048
#: Entries that are read of each list at first; the depth doubles from there.
SEGMENT = 64
#: So many vectors in question are resolved rather than read on for.
RESOLVE = 4 * K
STAGE_BYTES = 16 << 20
PIVOTS = 64
EXACT = 2**53


class Lists:
    """A block of candidates with one sorted list per dimension, read up to a depth from either end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n = len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, 0)
        self.rank = np.empty(x.shape, np.int64)  # place of a vector's entry in its dimension's list, from the bottom
        np.put_along_axis(self.rank, order, np.arange(n)[:, None].repeat(x.shape[1], 1), 0)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sorted[0], self.sorted[-1]

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Components as far as they are known at a depth: from the top at best and at worst, from the bottom at best and at worst."""
        n = len(self.x)
        low, high = self.heads()
        from_top, from_bottom = self.rank >= n - depth, self.rank < depth
        front_top, front_bottom = (self.sorted[n - depth - 1], self.sorted[depth]) if depth < n else (low, high)
        return np.where(from_top, self.x, front_top), np.where(from_top, self.x, low), np.where(from_bottom, self.x, front_bottom), np.where(from_bottom, self.x, high)


def survivors(q: np.ndarray, block: Lists, floor: np.ndarray, k: int, own: np.ndarray | None = None, resolve: int = RESOLVE, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(queries, candidates) matrix: may the candidate be among the query's k best? And the depth to which each query read the lists, 0 if the heads sufficed.

    ``floor`` has for each query a score that a candidate must reach to qualify; ``own`` marks candidates that don't count.
    """
    n, dims = block.x.shape
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    depths = np.zeros(len(q), np.int64)
    alive = np.zeros((len(q), n), bool)
    if not dims:
        alive[:] = True
        return alive if own is None else alive & ~own, depths
    low, high = block.heads()
    rows = np.flatnonzero(up @ high + down @ low >= floor)
    depth = 0
    while len(rows):
        depth = min(n, max(segment, 2 * depth))
        top_best, top_worst, bottom_best, bottom_worst = block.read(depth)
        best = up[rows] @ top_best.T + down[rows] @ bottom_best.T
        worst = up[rows] @ top_worst.T + down[rows] @ bottom_worst.T
        if own is not None:
            best[own[rows]] = worst[own[rows]] = -np.inf
        least = floor[rows]
        if n >= k:
            least = np.maximum(least, np.partition(worst, n - k, axis=1)[:, n - k])
        depths[rows] = depth
        alive[rows] = (best >= least[:, None]) & (best > -np.inf)
        if depth == n:
            break
        rows = rows[alive[rows].sum(1) > resolve]
    return alive, depths


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q.astype(np.float64), k
        self.exact = q
        self.scores: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)
        self.place = {i: n for n, i in enumerate(ids.tolist())}

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        own = np.zeros((len(self.ids), len(ids)), bool)
        for at, i in enumerate(ids.tolist()):
            if i in self.place:
                own[self.place[i], at] = True
        large = x.size and float(np.abs(x).max()) * float(np.abs(self.q).max()) * x.shape[1] >= EXACT
        if large:  # bounds in floating point would not be exact
            alive = ~own
        else:
            alive, _ = survivors(self.q, Lists(ids, x.astype(np.float64)), self.floor, self.k, own)
        for r in np.flatnonzero(alive.any(1)).tolist():
            at = np.flatnonzero(alive[r])
            score = x[at].astype(object) @ self.exact[r].astype(object) if large else x[at] @ self.exact[r]
            found = sorted(self.scores[r] + [(-int(v), int(i)) for v, i in zip(score.tolist(), ids[at].tolist(), strict=True)])[: self.k]
            self.scores[r] = found
            if len(found) == self.k:
                self.floor[r] = -found[-1][0]


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors as integers, one row an id."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    return table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack(block: int, cluster: bool):
    """Rows (vec_id, v) of a task -> blocks of vectors of one length, neighbours together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[tuple[int, list[int]]]] = {}

        def rows(key, own):
            ids, x = np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64).reshape(len(own), -1)
            if cluster and x.size and len(own) > block:
                near = np.argmax(x.astype(np.float64) @ x[:PIVOTS].T.astype(np.float64), axis=1)
                order = np.argsort(near, kind="stable")
                ids, x = ids[order], x[order]
            for a in range(0, len(ids), block):
                part = ids[a : a + block], x[a : a + block]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([len(part[0])], pa.int32()), pa.array([int(part[0].min())], pa.int64()), pa.array([part[0].tobytes()], pa.binary()), pa.array([part[1].tobytes()], pa.binary())], ["dims", "part", "n", "first", "ids", "data"])

        for batch in batches:
            for i, v, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = waiting.setdefault((len(v), p), [])
                own.append((i, v))
                if len(own) >= block * (16 if cluster else 1):
                    yield from rows((len(v), p), own)
                    waiting[(len(v), p)] = []
        for key, own in waiting.items():
            if own:
                yield from rows(key, own)

    return run


BLOCK_SCHEMA = "dims int, part int, n int, first long, ids binary, data binary"


BLOCK_SCHEMA = "dims int, part int, n int, first long, ids binary, data binary"


def search(table: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for every vector whose id is divisible by ``every``."""
    spark = table.sparkSession
    v = materialise(vectors(table), "topk-vectors")
    blocks = materialise(v.select("vec_id", "v", F.lit(0).alias("part")).mapInArrow(_pack(block, True), BLOCK_SCHEMA), "topk-blocks").select("ids", "data")
    asked = v.where(F.col("vec_id") % every == 0)
    n, longest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    stages = max(1, -(-n * 8 * (longest + 1) // STAGE_BYTES))
    target = f"{shared_dir(spark)}/topk-found-{uuid.uuid4().hex}"
    for stage in range(stages):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(stages)) == stage).orderBy("vec_id").toArrow()  # about STAGE_BYTES
        by_length: dict[int, list[tuple[int, list[int]]]] = {}
        for i, x in zip(rows.column("vec_id").to_pylist(), rows.column("v").to_pylist(), strict=True):
            by_length.setdefault(len(x), []).append((i, x))
        queries = [(np.array([i for i, _ in own[a : a + QUERY_BLOCK]], np.int64), np.array([x for _, x in own[a : a + QUERY_BLOCK]], np.int64).reshape(-1, d)) for d, own in by_length.items() for a in range(0, len(own), QUERY_BLOCK)]
        shared = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(i, q, k) for i, q in shared.value]
            for batch in batches:
                for ids, data in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    own = np.frombuffer(ids, np.int64)
                    x = np.frombuffer(data, np.int64).reshape(len(own), -1)
                    for b in best:
                        if b.q.shape[1] == x.shape[1]:
                            b.meet(own, x)
            out = [(i, j, -s) for b in best for i, found in zip(b.ids.tolist(), b.scores, strict=True) for s, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

        blocks.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(target)
        shared.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(target)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
