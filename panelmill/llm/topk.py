"""Exact top-k inner products by pivot-table elimination.

Components are quantised to floor(64 * x). Every vector has a row in a pivot table, its distances to
``PIVOTS`` pivots; the nearest pivot is its cell. For a query q and a vector x the largest
|d(q, p) - d(x, p)| is a lower bound of their distance, so (|q|^2 + |x|^2 - bound^2) / 2 is an
upper bound of their inner product.

1. Queries are scored in their own cell, in bound order, which gives each a k-th best score.
2. A query visits another cell only if the bound over the cell (from its ranges of pivot distances)
   reaches that score; in the cell, candidates are again taken in bound order until the bound of the
   rest is below the k-th best.

A cell is cut into blocks of bounded size by a hash, so a vector that a third of all rows share fills
blocks, not a task. Queries and blocks meet by an equi-join on the cell. Only the pivots
and one summary row for each cell (``PIVOTS`` of them) are sent everywhere.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without a vec_id; vectors of another length than a query's are not its candidates; rows that
share the query's vec_id are its own; repeated query rows are one query; ties go to the smaller vec_id.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, sample_by_hash, ship, stored

PIVOTS = 32
#: Rows that pivots are chosen from; any choice gives exact results.
PIVOT_SAMPLE = 2_000
BLOCK_ROWS, QUERY_ROWS, FIRST = 2_048, 512, 64
PART = "cell int, ids binary, data binary, dist binary"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300))
    out = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound)
    return out.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other (farthest first)."""
    chosen, best = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and best.max() > 0:
        chosen.append(int(best.argmax()))
        best = np.minimum(best, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _upper(qn: np.ndarray, xn: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product with room for rounding."""
    total = qn + xn
    return (total - bound * bound) / 2 + 1e-6 * (1 + total)


def _pairs(q: np.ndarray, qd: np.ndarray, x: np.ndarray, xd: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the block's best (ids, scores), at most k and none below ``least``; exact."""
    qn, xn = (q * q).sum(axis=1), (x * x).sum(axis=1)
    bound = np.zeros((len(q), len(x)))
    for p in range(qd.shape[1]):
        np.maximum(bound, np.abs(qd[:, p, None] - xd[None, :, p]), out=bound)
    upper = _upper(qn[:, None], xn[None, :], bound)
    del bound
    upper[own[:, None] == ids[None, :]] = -np.inf
    take = min(FIRST, len(x))
    order = np.argpartition(-upper, take - 1, axis=1)[:, :take]
    # Scores of small integers are exact in doubles; larger ones use whole numbers.
    exact = float(np.sqrt(qn.max() * xn.max())) < 2**52
    xi, qi = (x, q) if exact else (x.astype(np.int64), q.astype(np.int64))
    out = []
    for i in range(len(q)):
        first = order[i][np.isfinite(upper[i, order[i]])]
        score = xi[first] @ qi[i]
        limit = max(least[i], np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf)
        rest = np.flatnonzero((upper[i] >= limit) & np.isfinite(upper[i]))
        if len(rest) > len(first) or not np.isin(rest, first).all():
            first, score = rest, xi[rest] @ qi[i]
        at = np.flatnonzero(score >= limit)
        best = at[np.lexsort((ids[first[at]], -score[at]))][:k]
        out.append((i, ids[first[best]], score[best].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row whose id is divisible by *every*."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(quantised(vectors, scale), "vectors")
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    parts = [_of_length(rows.where(F.size("v") == n), every, k, n) for n in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())]
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def _of_length(rows: DataFrame, every: int, k: int, dims: int) -> DataFrame:
    sample = sample_by_hash(rows, PIVOT_SAMPLE, rows.count(), "vec_id", "v").collect()
    pivots = choose_pivots(np.array([r["v"] for r in sample], dtype=float))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, dims)
        dist = _distances(x, pivots)
        data = [r.tobytes() for r in x], [r.tobytes() for r in dist]
        return pa.record_batch([batch.column(0), pa.array(dist.argmin(axis=1).astype(np.int32)), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary()), pa.array((x * x).sum(axis=1)), pa.array([r for r in dist], pa.list_(pa.float64()))],
                               ["vec_id", "cell", "data", "dist", "norm", "d"])

    dealt = stored(map_batches(rows.select("vec_id", "v"), deal, "vec_id bigint, cell int, data binary, dist binary, norm double, d array<double>"), "dealt")
    n_pivots = len(pivots)
    ranges = [f(F.col("d")[p]).alias(f"{n}{p}") for p in range(n_pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *ranges).collect()}  # one row a pivot
    order = sorted(cells)
    lo = np.array([[cells[c][f"lo{p}"] for p in range(n_pivots)] for c in order])
    hi = np.array([[cells[c][f"hi{p}"] for p in range(n_pivots)] for c in order])
    norm = np.array([cells[c]["norm"] for c in order])

    def block(key: Any, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "data": [b"".join(part["data"])], "dist": [b"".join(part["dist"])]})

    def cut(df: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
        """Blocks of about *size* rows within a cell, dealt by a hash of whole rows and their ids."""
        many = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // size))]), F.col("cell"))
        return df.groupBy("cell", F.pmod(F.xxhash64("vec_id", "data"), many).alias("part")).applyInPandas(block, PART)

    blocks = stored(cut(dealt, {c: r["n"] for c, r in cells.items()}, BLOCK_ROWS), "blocks")
    queries = dealt.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "cell", "data", "dist")
    queries = stored(queries.withColumn("least", F.lit(float("-inf"))), "queries")

    def visit(asked: DataFrame) -> DataFrame:
        """Scores of (vec_id, cell, data, dist, least) in the cells they ask for."""
        counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        if not counts:
            return spark_empty(asked)

        def group(key: Any, part: pd.DataFrame) -> pd.DataFrame:
            return block(key, part).assign(least=[part["least"].to_numpy(np.float64).tobytes()])

        many = F.element_at(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // QUERY_ROWS))]), F.col("cell"))
        groups = asked.groupBy("cell", F.pmod(F.xxhash64("vec_id", "data"), many).alias("part")).applyInPandas(group, PART + ", least binary")
        names = ["ids", "data", "dist", "least"]
        both = groups.select("cell", *(F.col(c).alias(f"q_{c}") for c in names)).join(blocks, "cell")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [[], [], []]
            for r in batch.to_pylist():
                own = np.frombuffer(r["q_ids"], np.int64)
                q, qd = np.frombuffer(r["q_data"]).reshape(len(own), dims), np.frombuffer(r["q_dist"]).reshape(len(own), -1)
                ids = np.frombuffer(r["ids"], np.int64)
                x, xd = np.frombuffer(r["data"]).reshape(len(ids), dims), np.frombuffer(r["dist"]).reshape(len(ids), -1)
                for i, found, score in _pairs(q, qd, x, xd, ids, own, k, np.frombuffer(r["q_least"])):
                    got[0].append(np.full(len(found), own[i])), got[1].append(found), got[2].append(score)
            cols = [pa.array(np.concatenate(g) if g else np.zeros(0, np.int64), pa.int64()) for g in got]
            return pa.record_batch(cols, ["query_id", "vec_id", "score"])

        return map_batches(both.drop("cell"), run, "query_id bigint, vec_id bigint, score bigint")

    def best(found: DataFrame) -> DataFrame:
        rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    near = stored(visit(queries), "near")
    least = best(near).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    least = least.where(F.col("n") >= k).select("query_id", F.col("low").cast("double").alias("low"))
    known = queries.drop("least").join(least, queries["vec_id"] == least["query_id"], "left").withColumn("least", F.coalesce("low", F.lit(float("-inf"))))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each query once for every other cell whose bound reaches its k-th best score."""
        dist = np.stack([np.frombuffer(b) for b in batch.column(3).to_pylist()])
        q = np.stack([np.frombuffer(b) for b in batch.column(2).to_pylist()])
        own, low = batch.column(1).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
        gap = np.maximum(0, np.maximum(lo[None] - dist[:, None, :], dist[:, None, :] - hi[None])).max(axis=2)
        upper = _upper((q * q).sum(axis=1)[:, None], norm[None, :], gap)
        i, c = np.nonzero((upper >= low[:, None]) & (np.array(order)[None, :] != own[:, None]))
        at = pa.array(i)
        return pa.record_batch([batch.column(0).take(at), pa.array(np.array(order, dtype=np.int32)[c]), batch.column(2).take(at), batch.column(3).take(at), batch.column(4).take(at)], ["vec_id", "cell", "data", "dist", "least"])

    asked = stored(map_batches(known.select("vec_id", "cell", "data", "dist", "least"), spread, "vec_id bigint, cell int, data binary, dist binary, least double"), "asked")
    return best(near.unionByName(visit(asked))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spark_empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
