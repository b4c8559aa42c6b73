"""Exact top-k inner products by pivot-table elimination.

Vectors x become points (x, sqrt(M^2 - |x|^2)) with M the largest length, queries q become (q, 0): then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest points. For every point the
distances to fixed pivots are stored. Of a query the largest |d(q, p) - d(x, p)| over the pivots is a lower
bound of its distance to x; candidates are evaluated in the order of the bounds, and evaluation stops where
the bound passes the k-th best distance so far. Products are exact integers.

Queries and candidates are packed into blocks; each pair of blocks is one row of work and returns k rows a
query, so what travels grows with blocks, not with pairs of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, table

PIVOTS, BLOCK, FIRST = 16, 4096, 48


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component as double, of all vectors that are neither null nor empty and hold finite numbers alone."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("vec_id is not null and e is not null")
    fine = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("e") > 0))
    return fine.select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points (x, extra) to pivots (with their extra coordinate last)."""
    square = (x * x).sum(axis=1)[:, None] + (extra * extra)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(square, 0))


def _pack(rows: DataFrame, pivots: np.ndarray, longest: float | None) -> DataFrame:
    """One row a block: ids, vectors, distances to the pivots. longest: M for candidates, None for queries."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.concat_batches(held)
        ids = part.column(0).to_numpy()
        x = np.array(part.column(1).flatten(), np.float64).reshape(len(ids), -1)
        extra = np.zeros(len(ids)) if longest is None else np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
        values = [ids.tobytes(), x.astype(np.int64).tobytes(), _distances(x, extra, pivots).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["ids", "x", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = BLOCK
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, room)
                held.append(part)
                at, room = at + part.num_rows, room - part.num_rows
                if not room:
                    yield pack(held)
                    held, room = [], BLOCK
        if held:
            yield pack(held)

    return rows.mapInArrow(lean(run), "ids binary, x binary, d binary")


def _best(ids: np.ndarray, x: np.ndarray, d: np.ndarray, qid: int, q: np.ndarray, dq: np.ndarray, k: int, longest: float, exact: bool) -> list[tuple[int, int]]:
    """(score, vec_id) of a query's k best in a block."""
    low = np.abs(d - dq).max(axis=1)
    other = ids != qid
    order = np.argsort(low, kind="stable")
    order = order[other[order]]
    square = float((q.astype(np.float64) ** 2).sum())
    scores = np.empty(0, np.int64)
    seen = np.empty(0, np.int64)
    at, step = 0, FIRST
    while at < len(order):
        if len(scores) >= k:
            worst = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            reach = np.sqrt(max(square + longest - 2 * worst, 0)) * (1 + 1e-9) + 1e-3
            if low[order[at]] > reach:
                break
            stop = at + int(np.searchsorted(low[order[at:]], reach, side="right"))
        else:
            stop = len(order)
        part = order[at : min(stop, at + step)]
        product = (x[part].astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact else x[part] @ q
        scores, seen = np.concatenate([scores, product]), np.concatenate([seen, ids[part]])
        at, step = at + len(part), step * 4
    top = np.lexsort((seen, -scores))[:k]
    return [(int(scores[i]), int(seen[i])) for i in top]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest products among the candidates of another id, ties to the smaller id.

    queries and candidates: vec_id, v (array of whole numbers as double). Only vectors of equal length have a
    product; each length is a search of its own. Of queries that share a vec_id the least vector asks; candidates
    that share one are all candidates. An empty side gives no rows. Products that could leave 63 bits are refused.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sides = candidates.groupBy(F.size("v").alias("d")).agg(F.max(square).alias("m"), F.max(F.array_max(F.transform("v", F.abs))).alias("c"))
    asked = queries.groupBy(F.size("v").alias("d")).agg(F.max(F.array_max(F.transform("v", F.abs))).alias("q"))
    found = [_top_k(queries.where(F.size("v") == r["d"]), candidates.where(F.size("v") == r["d"]), k, r) for r in sides.join(asked, "d").orderBy("d").collect()]  # a row a length
    empty = candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found, empty)


def _top_k(queries: DataFrame, candidates: DataFrame, k: int, top: Row) -> DataFrame:
    """top_k of vectors of one length d; top: d, the candidates' largest square length m and component c, the queries' largest component q."""
    if top["c"] * top["q"] * top["d"] >= 2.0**63:
        raise OverflowError("products of these vectors don't fit into 63 bits")
    schema = "query_id long, vec_id long, score long"
    longest = float(top["m"])
    exact = top["c"] * top["q"] * top["d"] < 2**52
    picked = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    p = np.array([r["v"] for r in picked], np.float64)
    pivots = np.column_stack([p, np.sqrt(np.maximum(longest - (p * p).sum(axis=1), 0))])
    # as few blocks as their size allows: the work is one row for each pair of blocks
    blocks = lambda rows: rows.repartition(max(1, -(-rows.count() // BLOCK)))
    c = cut(_pack(blocks(candidates), pivots, longest)).select(*(F.col(x).alias(f"c_{x}") for x in ("ids", "x", "d")))
    q = cut(_pack(blocks(queries), pivots, None)).select(*(F.col(x).alias(f"q_{x}") for x in ("ids", "x", "d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cids, cx, cd, qids, qx, qd = (batch.column(i)[row].as_buffer() for i in range(6))
                ids, qid = np.frombuffer(cids, np.int64), np.frombuffer(qids, np.int64)
                x, y = np.frombuffer(cx, np.int64).reshape(len(ids), -1), np.frombuffer(qx, np.int64).reshape(len(qid), -1)
                d, e = np.frombuffer(cd, np.float64).reshape(len(ids), -1), np.frombuffer(qd, np.float64).reshape(len(qid), -1)
                out = [(int(qid[j]), v, s) for j in range(len(qid)) for s, v in _best(ids, x, d, int(qid[j]), y[j], e[j], k, longest, exact)]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = c.crossJoin(q).mapInArrow(lean(run), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(k)}").select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE = """WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
