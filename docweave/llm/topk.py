"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie dimension by dimension (vertical layout). Scores accumulate one block of dimensions at a time;
after each block the mass that is left in query and candidate bounds what the score can still become, and only
candidates whose upper bound reaches the k-th best lower bound are kept, compacted, for the next block.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import discard, mapped, stored

_LONG = 2**63 - 1
#: Beyond this, sums of products of integers are no longer exact in doubles.
_EXACT = 2.0**53


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, x as double."""
    return np.floor(scale * values.astype(np.float64))


def search_cell(cand_ids, cand_rows, cands, query_rows, queries, k, floors=None, block=16):
    """The k best of one cell for each query: lists of (query position, candidate id, score); none with a score below the query's floor.

    cands: (dimensions, n) integers as doubles; queries: (m, dimensions). The candidate that is the query's own row is left out; ties go to
    the smaller id.
    """
    dims, n = cands.shape
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    out: list[tuple[int, int, int]] = []
    if not n or not len(queries):
        return out
    if dims and max(1.0, np.abs(cands).max()) * max(1.0, np.abs(queries).max()) * dims >= _EXACT:
        return _search_large(cand_ids, cand_rows, cands, query_rows, queries, k)
    order = np.argsort(-np.abs(queries).sum(axis=0), kind="stable")  # heavy dimensions first
    cands, queries = np.ascontiguousarray(cands[order]), queries[:, order]
    edges = list(range(0, dims, block)) + [dims]
    # what is left of a vector's length from a dimension on
    tail_c = np.sqrt(np.maximum(0, np.cumsum((cands**2)[::-1], axis=0)[::-1]))
    tail_q = np.sqrt(np.maximum(0, np.cumsum((queries**2)[:, ::-1], axis=1)[:, ::-1]))
    longest = tail_c[0].max() if dims else 0.0
    able = np.flatnonzero(tail_q[:, 0] * longest * (1 + 1e-9) + 1e-6 >= floors) if dims else np.arange(len(queries))  # others have nothing here
    at_own = {int(r): i for i, r in enumerate(cand_rows)}
    for at in range(0, len(able), 64):
        part = able[at : at + 64]
        first = queries[part, : edges[1]] @ cands[: edges[1]] if dims else np.zeros((len(part), n))
        for i, q in enumerate(part):
            score = first[i]
            alive = None  # all
            own = at_own.get(int(query_rows[q]))
            if own is not None:
                alive = np.delete(np.arange(n), own)
                score = score[alive]
            floor = floors[q]
            for b in range(1, len(edges)):
                lo = edges[b]
                if lo >= dims:
                    break
                room = tail_q[q, lo] * (tail_c[lo] if alive is None else tail_c[lo, alive]) * (1 + 1e-9) + 1e-6
                if len(score) > k and (floor == -np.inf or 8 * len(score) < n):  # few are left, or no floor is known
                    floor = max(floor, np.partition(score - room, len(score) - k)[len(score) - k])
                keep = np.flatnonzero(score + room >= floor)
                alive, score = (keep if alive is None else alive[keep]), score[keep]
                hi = edges[b + 1]
                score = score + queries[q, lo:hi] @ cands[lo:hi][:, alive]
            if alive is None:
                alive = np.arange(n)
            enough = np.flatnonzero(score >= floors[q])
            alive, score = alive[enough], score[enough]
            if len(alive) > k:
                keep = score >= np.partition(score, len(alive) - k)[len(alive) - k]
                alive, score = alive[keep], score[keep]
            best = np.lexsort((cand_ids[alive], -score))[:k]
            out += [(int(q), int(cand_ids[alive[x]]), int(score[x])) for x in best]
    return out


def _search_large(cand_ids, cand_rows, cands, query_rows, queries, k):
    """As search_cell, for integers too large for exact doubles; scores outside a long are held at its ends."""
    rows = [[int(x) for x in column] for column in cands.T]
    out = []
    for i, q in enumerate(queries):
        q = [int(x) for x in q]
        found = [(-sum(x * y for x, y in zip(q, r)), int(c)) for r, c, u in zip(rows, cand_ids, cand_rows) if u != query_rows[i]]
        out += [(i, c, max(-_LONG - 1, min(_LONG, -s))) for s, c in sorted(found)[:k]]
    return out


def _by_length(table: pa.Table | pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: their places in the table, and scaled as rows of a matrix."""
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[int(length)] = at, scaled(flat[starts[at][:, None] + np.arange(length)], scale).reshape(len(at), length)
    return out


class Search:
    """The k best of each of a block of queries so far, as cell after cell of candidates comes by."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
        self.queries, self.k = queries, k  # by length of vector: rows, matrix, floors
        self.floors = {length: floors.copy() for length, (_, _, floors) in queries.items()}
        self.best: dict[int, list[tuple[int, int]]] = {}

    def add(self, cand_ids: np.ndarray, cand_rows: np.ndarray, cands: np.ndarray) -> None:
        """cands: rows of one length."""
        rows, matrix, _ = self.queries.get(cands.shape[1], (None, None, None))
        if rows is None:
            return
        floors = self.floors[cands.shape[1]]
        found: dict[int, list[tuple[int, int]]] = {}
        for q, c, score in search_cell(cand_ids, cand_rows, np.ascontiguousarray(cands.T), rows, matrix, self.k, floors):
            found.setdefault(q, []).append((-score, c))
        for q, new in found.items():
            own = self.best[int(rows[q])] = sorted(self.best.get(int(rows[q]), []) + new)[: self.k]
            if len(own) == self.k:
                floors[q] = max(floors[q], -own[-1][0])

    def rows(self):
        return [(u, c, -score) for u, own in self.best.items() for score, c in own]


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    cell_candidates: int = 16384,
    block_queries: int = 32768,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest integer inner products over all rows but itself.

    Components become floor(scale * x). Queries go block_queries at a time to all tasks, which read the candidates where they
    lie: no vector is shuffled, and what a pass sends along is a block of queries. A task keeps the k best of each query
    over its cells of cell_candidates vectors. For each block one cell in the root of their number is searched first; the k-th best scores
    found there are floors, below which the rest of the cells return nothing and, by the length of their longest vector, leave whole
    queries out. So a query's rows that are shuffled grow with the root of the number of cells.

    Defined cases: rows whose id is null, and vectors that are null, or hold a null or a non-finite component,
    take no part. Vectors are compared only with vectors of the same length. Repeated rows and rows of one id are rows of their own, as
    queries and as candidates; ties go to the smaller id. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = clean.where(F.col("i").isNotNull() & F.col("v").isNotNull() & ~odd)
    clean = stored(clean.withColumn("u", F.monotonically_increasing_id()), "vectors")  # written once, so that a row keeps its number
    n, asked = clean.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks = max(1, math.ceil(asked / block_queries))
    sampled = max(1, round(math.sqrt(n / cell_candidates)))
    block = F.pmod(F.xxhash64("u"), F.lit(blocks))
    first = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(sampled)) == 0
    best = Window.partitionBy("u").orderBy(F.desc("score"), F.asc("vec_id"))
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def searched(candidates: DataFrame, queries: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(queries)  # about block_queries vectors

        def search(batches):
            found, held, size = Search(shared.value, k), [], 0

            def cell():
                table = pa.Table.from_batches(held)
                ids, rows = table["i"].to_numpy(), table["u"].to_numpy()
                for _, (at, matrix) in _by_length(table, scale).items():
                    found.add(ids[at], rows[at], matrix)

            for b in batches:
                for at in range(0, b.num_rows, cell_candidates):
                    part = b.slice(at, cell_candidates)
                    if size and size + part.num_rows > cell_candidates:
                        cell()
                        held, size = [], 0
                    held.append(part)
                    size += part.num_rows
            if size:
                cell()
            rows = found.rows()
            for at in range(0, len(rows), 10_000):
                u, c, s = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["u", "vec_id", "score"])

        return mapped(candidates.select("i", "u", "v"), search, "u long, vec_id long, score long")

    out = []
    for b in range(blocks if asked else 0):
        asking = clean.where(F.col("q") & (block == b)).select("u", "i", "v").toArrow()  # about block_queries rows
        if not asking.num_rows:
            continue
        rows = asking["u"].to_numpy()
        own = {length: (rows[at], matrix, np.full(len(at), -np.inf)) for length, (at, matrix) in _by_length(asking, scale).items()}
        hits = stored(top(searched(clean.where(first), own)).drop("rank"), "first-hits")
        if sampled > 1:
            floor = {r["u"]: r["f"] for r in hits.groupBy("u").agg(F.min("score").alias("f"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # at most a row for each query
            own = {length: (us, matrix, np.array([floor.get(int(u), -np.inf) for u in us], dtype=float)) for length, (us, matrix, _) in own.items()}
            early, hits = hits, stored(top(hits.union(searched(clean.where(~first), own))).drop("rank"), "hits")
            discard(early)
        out.append(hits)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = top(reduce(DataFrame.union, out))
    return every.join(clean.where("q").select("u", F.col("i").alias("query_id")), "u").select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.u, a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.u <> b.u AND len(a.c) = len(b.c)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
"""
