"""Exact top-k inner products by Fagin's threshold algorithm in blocks.

Vectors and the stated queries meet in blocks of bounded size.  A block keeps its rows sorted by
each dimension; a query reads every list from its favourable end, scores the rows that come up,
and stops once the sum of the list values just read can't beat its k-th score.  The blocks'
results are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import by_groups, named, stored

VECTOR_BLOCK = 4096
QUERY_BLOCK = 512


def threshold_top_k(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, query: np.ndarray, own: np.ndarray, k: int, first: int = 16) -> list[tuple[int, int]]:
    """``(vec_id, score)`` of the k best rows but those that ``own`` marks, ties to the smaller id.

    ``lists[:, d]`` are the rows in ascending order of dimension d.
    """
    n, dims = len(ids), np.flatnonzero(query)
    weights, up = query[dims], query[dims] > 0
    seen = np.zeros(n, dtype=bool)
    best_ids, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=vectors.dtype)
    begin, end = 0, min(first, n)
    while begin < n:
        at = np.where(up, n - 1 - np.arange(begin, end)[:, None], np.arange(begin, end)[:, None])
        rows = lists[at, dims] if len(dims) else np.arange(n)[:, None]
        fresh = np.zeros(n, dtype=bool)
        fresh[rows.ravel()] = True
        fresh &= ~seen
        seen |= fresh
        fresh = np.flatnonzero(fresh)
        fresh = fresh[~own[fresh]]
        best_ids, best_scores = np.concatenate((best_ids, ids[fresh])), np.concatenate((best_scores, vectors[fresh] @ query))
        top = np.lexsort((best_ids, -best_scores))[:k]
        best_ids, best_scores = best_ids[top], best_scores[top]
        if not len(dims):
            break
        bound = (vectors[rows[-1], dims] * weights).sum()
        if len(best_scores) == k and bound < best_scores[-1]:
            break
        begin, end = end, min(2 * end, n)
    return [(int(i), int(s)) for i, s in zip(best_ids, best_scores)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products of floored components.

    Components are ``floor(scale * x)``.  Vectors that are null, empty, or hold null or non-finite
    components take no part; only vectors of equal length are compared; fewer candidates than k
    give all of them; equal scores go to the smaller id; an empty table gives no rows.  Rows without an id take no part.  Rows that share an
    id are candidates each, also of one another, and each that asks gets ranks of its own under that id.
    """
    x = F.col("x")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (
        vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("x"), is_query.alias("asks"))
        .where(x.isNotNull() & (F.size(x) > 0))
        .where(F.coalesce(sound, F.lit(False)))
        .where("vec_id IS NOT NULL")
        .select("vec_id", "asks", F.size(x).cast("long").alias("dims"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))
    )
    # a key for each row, fixed by writing it, as ids may repeat
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asked = -(-max(1, sizes["n"]) // VECTOR_BLOCK), -(-max(1, sizes["q"]) // QUERY_BLOCK)
    dealt = F.pmod(F.xxhash64("key"), F.lit(blocks)), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(asked))
    held = rows.select("dims", dealt[0].alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("q"), F.lit(False).alias("asks"), "key", "vec_id", "v")
    asks = rows.where("asks").select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), dealt[1].alias("q"), F.lit(True).alias("asks"), "key", "vec_id", "v")

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b, e in zip(bounds, bounds[1:]):
            part = table.slice(b, e - b)
            ids, keys, marks = part["vec_id"].to_numpy(), part["key"].to_numpy(), part["asks"].to_numpy()
            values = np.array(part["v"].to_pylist(), dtype=np.int64)
            if marks.all() or not marks.any():
                continue
            if float(np.abs(values).max()) ** 2 * values.shape[1] < 2**53:
                values = values.astype(np.float64)  # exact, and multiplied faster
            own, queries = values[~marks], values[marks]
            lists = np.argsort(own, axis=0, kind="stable")
            found = [(key, q, *hit) for key, q, v in zip(keys[marks].tolist(), ids[marks].tolist(), queries) for hit in threshold_top_k(ids[~marks], own, lists, v, keys[~marks] == key, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, ["key", "query_id", "vec_id", "score"])

    hits = by_groups(held.unionByName(asks), ["dims", "b", "q"], work, "key long, query_id long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
