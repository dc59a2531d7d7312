"""Exact top-k inner products by columnar branch-and-bound.

Vectors are integers, dimensions in the order of the queries' energy, a block of
candidates in vertical layout (one row per dimension), largest norms first.  For
each query, scores are accumulated dimension block by dimension block.  After
each, what a pair can still gain is at most the product of the norms of both
remainders (Cauchy and Schwarz); candidates that can't reach the query's k-th best
score any more are dropped, and the survivors are compacted.  Before the first
block, whole candidates are dropped whose norm is too small.

The k-th best score is bounded from the start by ``SEEDS`` candidates (those with the
smallest hashes of their ids), and grows with every block.  It only decides how
much is pruned, never the result.

Scores are exact: sums of integer products below 2**53 in doubles; rows with
larger components meet the others in Python integers, without pruning.

Candidates stay where they are read.  Queries come to them in blocks: a block
table is broadcast only below ``QUERY_BYTES``, one pass over the candidates for
each such part, so nothing that grows with the data is broadcast whole.  Every
task returns its k best for each query; those are merged by a shuffle on the query.

Defined results: vectors that are null, or hold a null, NaN or infinite
component, take no part, neither do rows without an id; vectors of different
length meet as if the shorter ended in zeros; scores beyond 64 bits count as the
nearest 64-bit integer; a query with fewer than k partners has fewer rows; an empty
table gives no rows; repeated ids are candidates of their own, except that a query
never meets its own id; queries with the same id and vector have one list, those
with the same id and different vectors one each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 20
SCALE = 64
#: Dimensions added at a time; candidates in a block; candidates that give the first bounds.
DIMS, CANDIDATES, SEEDS = 16, 8192, 2048
#: Bytes of queries sent to the executors for one pass.
QUERY_BYTES = 16 << 20
#: A score of vectors of up to this norm is exact in doubles.
NORM = float(1 << 26)
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)

SCHEMA = "query_id long, variant long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and integer vector (as doubles, which hold it exactly) of the rows that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    product = lambda v: F.lit(float(scale)) * v.cast("double")
    # Doubles from 2**53 on are integers already.
    scaled = F.transform(x, lambda v: F.when(F.abs(product(v)) < float(1 << 53), F.floor(product(v)).cast("double")).otherwise(product(v)))
    return vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, the shorter filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, sizes = len(column), np.asarray(column.value_lengths())
    out = np.zeros((n, int(sizes.max(initial=0))))
    if out.size:
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.asarray(column.flatten(), dtype=np.float64)
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def clamped(value: int) -> int:
    return min(max(value, _LEAST), _MOST)


class Queries:
    """Query vectors with what bounds their scores."""

    def __init__(self, ids: np.ndarray, variants: np.ndarray, vectors: np.ndarray):
        self.ids, self.variants, self.vectors = ids, variants, vectors
        self.order = np.argsort(-(vectors**2).sum(0), kind="stable")  # dimensions, the most energy first
        self.least = np.full(len(ids), -np.inf)  # a score that k candidates reach

    def seed(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        """Lower bounds from some of the candidates."""
        width = max(vectors.shape[1], self.vectors.shape[1])
        q, x = widened(self.vectors, width), widened(vectors, width)
        plain = np.sqrt((x**2).sum(1)) <= NORM
        ids, x = ids[plain], x[plain]
        if len(ids) <= k:
            return
        for at in range(0, len(q), 1024):
            scores = q[at : at + 1024] @ x.T
            scores[self.ids[at : at + 1024, None] == ids[None, :]] = -np.inf
            self.least[at : at + 1024] = np.partition(scores, len(ids) - k, 1)[:, len(ids) - k]
        self.least[np.sqrt((q**2).sum(1)) > NORM] = -np.inf


class Search:
    """The k best candidates so far of each query, and how many pairs each step left."""

    def __init__(self, queries: Queries, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), sorted
        self.least = queries.least.copy()
        self.left: Counter = Counter()

    def offer(self, i: int, ids: list[int], scores: list[int]) -> None:
        best = sorted([*self.found[i], *((-clamped(s), c) for s, c in zip(scores, ids, strict=True))])[: self.k]
        self.found[i] = best
        if len(best) == self.k:
            self.least[i] = max(self.least[i], float(-best[-1][0]))

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Meet a block of candidates."""
        q = self.q.vectors
        width = max(x.shape[1], q.shape[1])
        order = np.concatenate([self.q.order, np.arange(q.shape[1], width)])
        q, x = widened(q, width)[:, order], widened(x, width)[:, order]
        norms, lengths = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
        plain = lengths <= NORM
        self.exact(np.flatnonzero(norms > NORM), q, ids, x)
        self.exact(np.flatnonzero(norms <= NORM), q, ids[~plain], x[~plain])
        far = np.flatnonzero(plain)[np.argsort(-lengths[plain], kind="stable")]
        ids, lengths = ids[far], lengths[far]
        columns = np.ascontiguousarray(x[far].T)
        steps = list(range(0, width, DIMS))
        rest = [np.sqrt((columns[d:] ** 2).sum(0)) for d in steps[1:]]
        mine = [np.sqrt((q[:, d:] ** 2).sum(1)) for d in steps[1:]]
        # The first dimensions of all pairs at once; from then on each query has its own survivors.
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            first = q[part, :DIMS] @ columns[:DIMS]
            for i in range(at, min(at + 256, len(q))):
                if norms[i] <= NORM:
                    self.one(i, q[i], norms[i], ids, lengths, columns, first[i - at], rest, [m[i] for m in mine])

    def one(self, i: int, q: np.ndarray, norm: float, ids: np.ndarray, lengths: np.ndarray, columns: np.ndarray, scores: np.ndarray, rest: list[np.ndarray], mine: list[float]) -> None:
        least = self.least[i]
        n = len(ids)
        if least > 0:  # largest norms come first
            n = int(np.searchsorted(-(lengths * norm * (1 + 1e-9) + 1e-6), -least, "right"))
        alive = np.flatnonzero(self.q.ids[i] != ids[:n])
        self.left["pairs"] += len(ids)
        self.left["norm"] += len(alive)
        scores = scores[alive]
        for step, (own, other) in enumerate(zip(mine, rest, strict=True), 1):
            keep = scores + own * other[alive] * (1 + 1e-9) + 1e-6 >= least
            alive, scores = alive[keep], scores[keep]
            self.left[step] += len(alive)
            if not len(alive):
                return
            dims = slice(step * DIMS, (step + 1) * DIMS)
            scores = scores + q[dims] @ columns[dims].take(alive, 1)
        keep = scores >= least
        alive, scores = alive[keep], scores[keep]
        if len(alive) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            alive, scores = alive[scores >= cut], scores[scores >= cut]
        if len(alive):
            self.offer(i, ids[alive].tolist(), [int(s) for s in scores.tolist()])

    def exact(self, which: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Scores of large vectors in Python integers."""
        if not len(which) or not len(ids):
            return
        rows = [[int(v) for v in row] for row in x.tolist()]
        for i in which.tolist():
            own = [int(v) for v in q[i].tolist()]
            met = [k for k in range(len(rows)) if ids[k] != self.q.ids[i]]
            self.offer(i, [int(ids[k]) for k in met], [sum(a * b for a, b in zip(own, rows[k], strict=True)) for k in met])

    def rows(self) -> pa.RecordBatch:
        n = [len(f) for f in self.found]
        flat = [x for f in self.found for x in f]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.q.ids, n)), pa.array(np.repeat(self.q.variants, n)), pa.array([c for _, c in flat], pa.int64()), pa.array([-s for s, _ in flat], pa.int64())],
            names=["query_id", "variant", "vec_id", "score"],
        )


def scan(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Search:
    """All candidates of a task, a block at a time."""
    search, held, rows = Search(queries, k), [], 0

    def meet() -> None:
        t = pa.Table.from_batches(held)
        search.block(np.asarray(t["vec_id"]), matrix(t["v"]))

    for b in batches:
        for at in range(0, b.num_rows, CANDIDATES):
            held.append(b.slice(at, CANDIDATES))
            rows += held[-1].num_rows
            if rows >= CANDIDATES:
                meet()
                held, rows = [], 0
    if rows:
        meet()
    return search


def query_blocks(vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> Iterator[Queries]:
    """The queries in blocks of bounded size, with their first bounds."""
    asked = integers(queries, scale).withColumn("variant", F.xxhash64("v")).distinct()
    seeds = integers(vectors, scale).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow()
    total = asked.agg(F.sum(F.size("v") * 8 + 16).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // QUERY_BYTES))
    if parts > 1:
        asked = written(asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "variant"), F.lit(parts)).cast("int")), "queries")
    for p in range(parts):
        t = (asked.where(F.col("part") == p) if parts > 1 else asked).toArrow()
        block = Queries(np.asarray(t["vec_id"]), np.asarray(t["variant"]), matrix(t["v"]))
        block.seed(np.asarray(seeds["vec_id"]), matrix(seeds["v"]), k)
        yield block


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    spark, found = vectors.sparkSession, None
    candidates = integers(vectors, scale)
    for block in query_blocks(vectors, queries, k, scale):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            if len(sent.value.ids):
                yield scan(batches, sent.value, k).rows()

        part = candidates.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
