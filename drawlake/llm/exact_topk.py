"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

The rows are cut into index blocks and the queries into query blocks of bounded size; every query
meets every index block once.  Inside a pair of blocks the index is held as postings by dimension.
A query walks its non-zero terms, scatters ``weight * posting`` into a dense array of scores, and a
partition selection keeps its k best.  The blocks' selections are merged with a ranking window.

Defined results: vectors that are null, hold null or a non-finite component take no part; an empty
vector scores 0 against everything; vectors of unequal length meet on their common dimensions;
repeated rows of one id are separate candidates; those of equal vectors are one query, those of different
vectors are queries of their own, ranked apart under the same id; an empty table gives no rows.
Scores are exact while they fit a 64-bit integer.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import ship

#: Rows in an index block and queries in a query block: the most that one task holds at once.
INDEX_BLOCK, QUERY_BLOCK = 2048, 2048


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as 64-bit integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    top = float(np.finfo(np.float64).max)
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(top), F.lit(False)))


def postings(vectors: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows with a non-zero value there, and those values."""
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    dims = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
    values = np.concatenate(vectors).astype(np.int64) if len(vectors) else np.zeros(0, np.int64)
    keep = values != 0
    rows, dims, values = rows[keep], dims[keep], values[keep]
    order = np.argsort(dims, kind="stable")
    rows, dims, values = rows[order], dims[order], values[order]
    ends = np.searchsorted(dims, np.arange(lengths.max(initial=0) + 1))
    return [(rows[a:b], values[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def accumulate(query: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> None:
    """Scatter the query's weighted postings into ``scores``, one term at a time."""
    for term in np.flatnonzero(query[: len(index)]):
        rows, values = index[term]
        if len(rows) == len(scores):
            scores += query[term] * values
        else:
            scores[rows] += query[term] * values


def select(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best allowed scores; earlier positions win ties."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = scores[at]
        edge = np.partition(own, len(own) - k)[len(own) - k]
        above = at[own > edge]
        at = np.concatenate([above, at[own == edge][: k - len(above)]])
    return at


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["vec_id"].to_numpy()
        vectors = left["ints"].to_pylist()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        index = postings([np.array(vectors[i], dtype=np.int64) for i in order])
        out_q, out_a, out_v, out_s = [], [], [], []
        scores = np.zeros(len(ids), dtype=np.int64)
        for qid, ask, query in zip(right["vec_id"].to_pylist(), right["ask"].to_pylist(), right["ints"].to_pylist()):
            scores[:] = 0
            accumulate(np.array(query, dtype=np.int64), index, scores)
            best = select(scores, ids != qid, k)
            out_q.append(np.full(len(best), qid, dtype=np.int64))
            out_a.append(np.full(len(best), ask, dtype=np.int64))
            out_v.append(ids[best])
            out_s.append(scores[best])
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), type=pa.int64())
        return pa.table({"query_id": join(out_q), "ask": join(out_a), "vec_id": join(out_v), "score": join(out_s)})

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every row that ``is_query`` selects.

    ``is_query`` may use the columns of ``vectors``.  Ranks start at 1; equal scores go to the smaller id.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col), scale).alias("ints"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_index, n_query = max(1, -(-total // index_block)), max(1, -(-asked // query_block))
    mixed = lambda n, seed: F.pmod(F.xxhash64("vec_id", "ints", F.lit(seed)), F.lit(n)).cast("int")
    index = rows.select("vec_id", "ints", mixed(n_index, 1).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    asks = rows.where("asks").select("vec_id", "ints").dropDuplicates()
    asks = asks.select("vec_id", "ints", F.xxhash64("ints").alias("ask"), mixed(n_query, 2).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))).alias("ib"))
    found = index.groupBy("ib", "qb").cogroup(asks.groupBy("ib", "qb")).applyInArrow(_search(k), "query_id long, ask long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every row whose id is divisible by 50, over all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), t AS (
  SELECT vec_id, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM e
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
