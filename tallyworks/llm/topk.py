"""Exact top-k search by inner product, with bounds from segment statistics from coarse to fine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import table

#: Queries of a block, and components of a block of rows: each is held by one task.
BLOCK, COMPONENTS = 8_192, 2_000_000
#: Rows that are worth a block of their own where there are fewer than Spark has tasks.
SMALL = 2_048
#: Segments of the levels, from coarse to fine; those with one component for each are the vectors themselves.
LEVELS = (8, 16, 32, 48, 56)
#: Queries and rows whose bounds are held in memory at once, and for each result rows that give a first threshold.
QUERIES, ROWS, FAVOURED = 512, 4096, 4
#: Pairs in which exact scores are computed at once, and the part of all pairs above which a whole matrix is.
PAIRS, DENSE = 200_000, 0.2
#: Sums of products below this are exact in doubles.
EXACT = 2.0**52


def scaled(vectors: list) -> np.ndarray:
    """floor(256 * x) of each component, as doubles that hold whole numbers."""
    return np.floor(256 * np.asarray(vectors, np.float64))


def edges(dims: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, dims, min(segments, dims) + 1).astype(int))


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Sums and deviations of the segments, scaled so that the product of two rows bounds the inner product from above.

    With mean m and deviation s of a segment of length w, the part of the inner product that it
    holds is at most w * (m * m' + s * s'), by the inequality of Cauchy and Schwarz.
    """
    cuts = edges(vectors.shape[1], segments)
    width = np.diff(cuts)
    means = np.add.reduceat(vectors, cuts[:-1], axis=1) / width
    squares = np.add.reduceat((vectors - np.repeat(means, width, axis=1)) ** 2, cuts[:-1], axis=1)
    return np.hstack([means * np.sqrt(width), np.sqrt(squares[:, width > 1])])


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two arrays as whole numbers; beyond the range of a long, its ends."""
    if len(a) == 0 or a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), ends.min), ends.max) for p, q in zip(a, b, strict=True)], np.int64)


class Searcher:
    """The k best rows seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [s for s in levels if s < vectors.shape[1]] or [1]
        self.bounds = [statistics(vectors, s) for s in self.levels]
        self.norms = np.linalg.norm(vectors, axis=1)
        self.best = np.zeros((0, 3), np.int64)  # query's place, score, vec_id: in that order, the best first
        self.least = np.full(len(ids), -np.inf)
        self.verified = 0

    def keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take these scores into account."""
        rows = np.concatenate([self.best, np.column_stack([query, score, ids])])
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]  # ~x falls as x rises, and doesn't overflow
        opens = np.flatnonzero(np.append(True, np.diff(rows[:, 0]) != 0)) if len(rows) else np.zeros(0, int)
        place = np.arange(len(rows)) - np.repeat(opens, np.diff(np.append(opens, len(rows))))
        self.best = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]

    def exact(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.verified += len(query)
        for at in range(0, len(query), PAIRS):
            q, r = query[at : at + PAIRS], row[at : at + PAIRS]
            score = whole_products(self.vectors[q], vectors[r])
            better = score >= self.least[q]
            self.keep(q[better], score[better], ids[r[better]])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Bounds from coarse to fine leave fewer and fewer pairs of a query and a row, and exact scores decide among the rest.

        As long as a query has no threshold, the rows that the finest bounds favour give it one;
        they are left out afterwards.
        """
        bounds = [statistics(vectors, s) for s in self.levels]
        norms = np.linalg.norm(vectors, axis=1)
        for low in range(0, len(self.ids), QUERIES):
            block = np.arange(low, min(low + QUERIES, len(self.ids)))
            slack = 1 + 1e-9 * self.norms[block, None] * norms  # for rounding
            alive = self.ids[block, None] != ids
            if np.isinf(self.least[block]).any():
                k = min(FAVOURED * self.k, len(ids))
                finest = np.where(alive, self.bounds[-1][block] @ bounds[-1].T, -np.inf)
                top = np.argpartition(-finest, k - 1, axis=1)[:, :k]
                query, row = np.repeat(np.arange(len(block)), k), top.ravel()
                other = alive[query, row]
                self.exact(block[query[other]], row[other], ids, vectors)
                alive[query, row] = False
            for mine, theirs in zip(self.bounds, bounds, strict=True):
                if alive.mean() > DENSE:
                    alive &= mine[block] @ theirs.T + slack >= self.least[block, None]
                else:
                    q, r = np.nonzero(alive)
                    for at in range(0, len(q), PAIRS):
                        a, b = q[at : at + PAIRS], r[at : at + PAIRS]
                        alive[a, b] = np.einsum("ij,ij->i", mine[block[a]], theirs[b]) + slack[a, b] >= self.least[block[a]]
            q, r = np.nonzero(alive)
            self.exact(block[q], r, ids, vectors)


FOUND = "query_id long, number long, vec_id long, score long"


def block_search(k: int):
    """A function over a block of queries and a block of rows that gives the k best rows of the block for each query."""

    def by_length(vectors: pa.Table) -> dict[int, np.ndarray]:
        lengths = vectors["embedding"].combine_chunks().value_lengths().to_numpy()
        return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}

    def some(vectors: pa.Table, rows: np.ndarray, n: int) -> np.ndarray:
        return scaled(vectors["embedding"].take(pa.array(rows)).combine_chunks().flatten().to_numpy().reshape(-1, n))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [np.zeros((0, 4), np.int64)]
        candidates = by_length(rows) if len(rows) else {}
        for n, own in (by_length(queries) if len(queries) else {}).items():
            if n not in candidates:
                continue
            query_ids, numbers = (queries[c].to_numpy()[own] for c in ("query_id", "number"))
            searcher, ids = Searcher(query_ids, some(queries, own, n), k), rows["vec_id"].to_numpy()
            for at in range(0, len(candidates[n]), ROWS):
                take = candidates[n][at : at + ROWS]
                searcher.add(ids[take], some(rows, take, n))
            query, score, row = searcher.best.T
            parts.append(np.column_stack([query_ids[query], numbers[query], row, score]))
        found = np.concatenate(parts)
        return pa.table({name: pa.array(found[:, i]) for i, name in enumerate(("query_id", "number", "vec_id", "score"))})

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose id isn't null and whose components are all finite."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, components: int = COMPONENTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the largest inner products of floor(256 * x).

    Queries and rows are dealt into blocks, and each pair of blocks is one group of a cogroup, so
    a task holds one block of either sort at a time. Queries are dealt by their hash, rows by their
    place in the table, which should be one that gives them in the same order when it is read again; only the k best rows of each block and query
    are shuffled again. Rows with a query's own vec_id are no candidates; every other row is, also
    those that repeat. Ties go to the smaller vec_id. Rows with a null id, no components or a
    component that is null or not finite take no part; vectors are compared with those of as many
    components. Query rows that are alike in id and vector are one query; those that share an id
    only are queries of their own. A score beyond the range of a long is its end. Queries with
    fewer than k candidates get all; without queries or rows there are none. No other column is read.
    """
    rows, asked = usable(vectors), usable(queries).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dims")).first()
    row_blocks = max(1, math.ceil(size.n * size.dims / components), min(rows.sparkSession.sparkContext.defaultParallelism, size.n // SMALL))
    query_blocks = max(1, math.ceil(asked.count() / block))
    dealt = lambda blocks: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = rows.withColumn("row_block", dealt(row_blocks)).withColumn("query_block", every(query_blocks))
    numbered = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "embedding").alias("number"), "embedding")
    mine = numbered.withColumn("query_block", F.pmod("number", F.lit(query_blocks)).cast("int")).withColumn("row_block", every(row_blocks))
    pairs = mine.groupBy("row_block", "query_block").cogroup(own.groupBy("row_block", "query_block"))
    best = pairs.applyInArrow(block_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
scores AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""
