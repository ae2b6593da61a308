"""Operator 7: approximate nearest neighbours by collision counting.

A shard of vectors is projected on M random directions and sorted along each. A query's windows are
centred on its own projections; virtual rehashing widens all of them by one factor a level, and each
level counts only what the wider windows add. A vector that has collided in LIMIT of the directions is
a candidate; the windows stop once enough vectors have become one, and candidates are verified by their
cosine in double precision.

Scale: vectors are dealt by hash into shards of bounded size and move once; a copy of each query goes to
every shard. A task indexes its shard's vectors, which stand first, and then works on queries as they
stream in, so that neither side is held whole. All shards together verify about CANDIDATES vectors a
query, whatever their number. Counting collisions touches a share of all rows for each query: with a
query for every fifty rows, as here, that part of the work grows with the square of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import kept, table

#: Directions, and of them those in which a candidate has collided.
M, LIMIT = 64, 0.75
#: Half a window at the first level, in units of the deviation of unit vectors' projections, its growth,
#: and where growth ends: the next window is the whole array.
FIRST_WINDOW, GROWTH, LAST_WINDOW = 0.7, 1.3, 4.0
#: About how many candidates of all shards together a query verifies; how many more deviations a shard takes of its
#: share, for it may have more of them than others; and the least of a shard.
CANDIDATES, SLACK, LEAST = 1024, 4.0, 32
SEED = 7
SHARD_ROWS, SHARDS, MOST_SHARD_ROWS = 8192, 64, 32_768
QUERY_BLOCK = 256


def budget(shards: int) -> int:
    """Candidates of a query in each of so many shards."""
    share = CANDIDATES / shards
    return max(LEAST, math.ceil(share + (SLACK * math.sqrt(share) if shards > 1 else 0)))


def directions(dim: int) -> np.ndarray:
    """M directions: random orthonormal bases, scaled so that a unit vector's projections have variance one."""
    rng = np.random.default_rng((SEED, dim))
    bases = []
    while sum(b.shape[1] for b in bases) < M:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        bases.append(q * np.sqrt(dim))
    return np.concatenate(bases, axis=1)[:, :M]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. A row is first divided by its largest component, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class ShardIndex:
    """Sorted projections of a shard's vectors (rows of length one)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.axes = directions(vectors.shape[1])
        projected = (vectors @ self.axes).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def windows(self, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the first and last places (queries, M) of the windows round the queries' projections; the last ones are the whole arrays."""
        half = FIRST_WINDOW
        while half < LAST_WINDOW:
            lo = [np.searchsorted(s, c - half) for s, c in zip(self.sorted, centres.T, strict=True)]
            hi = [np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, centres.T, strict=True)]
            yield np.array(lo).T, np.array(hi).T
            half *= GROWTH
        yield np.zeros(centres.shape, np.int64), np.full(centres.shape, len(self.vectors))

    def candidates(self, levels: list[tuple[np.ndarray, np.ndarray]], want: int) -> np.ndarray:
        """Rows whose collisions with one query's windows, level by level, reach the limit, or a higher one that ``want`` rows reach; all if there are no more."""
        n, limit = len(self.vectors), math.ceil(LIMIT * M)
        if n <= want:
            return np.arange(n)
        counts = np.zeros(n, np.int64)
        before = None
        for lo, hi in levels:
            if before is None:
                spans = zip(self.order, lo.tolist(), hi.tolist(), strict=True)
            else:
                spans = [*zip(self.order, lo.tolist(), before[0].tolist(), strict=True), *zip(self.order, before[1].tolist(), hi.tolist(), strict=True)]
            counts += np.bincount(np.concatenate([o[a:b] for o, a, b in spans]), minlength=n)
            before = lo, hi
            if np.count_nonzero(counts >= limit) >= want:
                break
        # the threshold rises as long as enough vectors reach it
        return np.flatnonzero(counts >= max(limit, np.partition(counts, n - want)[n - want]))

    def best(self, queries: np.ndarray, keys: np.ndarray, own: list[int], k: int, want: int):
        """For each query (rows, cosines) of the k nearest candidates, ties to the smaller key; its own row is left out."""
        levels = list(self.windows(queries @ self.axes))
        for i, query in enumerate(queries):
            rows = self.candidates([(lo[i], hi[i]) for lo, hi in levels], want)
            rows = rows[rows != own[i]]
            cosine = (self.vectors[rows] * query).sum(axis=1)  # row by row, so that equal vectors have equal cosines
            top = np.lexsort((keys[rows], -cosine))[:k]
            yield rows[top], cosine[top]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


FOUND = "query_id long, query_row long, vec_id long, row_id long, score double"


def _search(k: int, want: int):
    """Rows sorted by dimension and shard, in each the vectors before the queries -> the nearest of each query in its shard."""
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("row_id", pa.int64()), ("score", pa.float64())])

    def parts(batches):
        """Runs of rows of one dimension, shard and kind."""
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "is_query")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                for c in range(a, b, QUERY_BLOCK if keys[a, 2] else b - a):
                    yield tuple(keys[a, :2]), bool(keys[a, 2]), batch.slice(c, min(b - c, QUERY_BLOCK) if keys[a, 2] else b - a)

    def run(batches):
        group, held, index, keys, ids = None, [], None, None, None
        for of, is_query, part in parts(batches):
            if of != group:
                group, held, index = of, [], None
            if not is_query:
                held.append((_vectors(part.column("embedding")), part.column("vec_id").to_numpy(), part.column("row_id").to_numpy()))
                continue
            if index is None and held:
                index = ShardIndex(np.concatenate([v for v, _, _ in held]))
                keys, ids = (np.concatenate([h[i] for h in held]) for i in (1, 2))
                at = {r: i for i, r in enumerate(ids.tolist())}
                held = []
            if index is None:
                continue
            rows = part.column("row_id").to_pylist()
            best = index.best(_vectors(part.column("embedding")), keys, [at.get(r, -1) for r in rows], k, want)
            out = [(q, r, keys[found], ids[found], score) for q, r, (found, score) in zip(part.column("vec_id").to_pylist(), rows, best, strict=True)]
            size = [len(o[2]) for o in out]
            columns = [np.repeat([o[0] for o in out], size), np.repeat([o[1] for o in out], size), *(np.concatenate([o[i] for o in out]) for i in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty, zero or holds null or non-finite components; numbered."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    whole = whole.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return kept(whole.withColumn("row_id", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))


def search(vectors: DataFrame, every: int, k: int = 5) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, its k nearest others.

    Rows with equal vec_ids are rows of their own; only the query's own row is left out. Vectors of
    another dimension than the query's are not compared. Fewer than k others give fewer rows. Components of
    any finite size are right; vectors that are null, empty, zero or hold null or non-finite components,
    and null vec_ids, take no part. Ties go to the smaller vec_id. An empty table gives an empty one.
    """
    rows = usable(vectors)
    size = min(max(SHARD_ROWS, -(-rows.count() // SHARDS)), MOST_SHARD_ROWS)
    counts = {r["dim"]: max(1, -(-r["n"] // size)) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dimension
    if not counts:
        counts = {0: 1}
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("dim"))
    dealt = rows.select("*", F.pmod(F.xxhash64("row_id"), shards).cast("int").alias("shard"), F.lit(0).alias("is_query"))
    asked = rows.where(F.col("vec_id") % every == 0).select("*", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(1).alias("is_query"))
    grouped = dealt.union(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "is_query")
    best = grouped.mapInArrow(_search(k, budget(max(counts.values()))), FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "row_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=50)
