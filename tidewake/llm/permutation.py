"""Nearest neighbours by a permutation index.

A vector is represented by its ``ORDERED`` nearest pivots in order of nearness. Blocks of vectors
post (row, place) under every pivot of their representation. A query adds, for each of its pivots,
``ORDERED - max(place in query, place in vector)`` to the rows posted there; twice the sum of these is
what the induced footrule distance is short of its maximum, so the rows with the greatest sums are
the nearest by footrule. The best ``share`` of every block is ranked again by exact cosine.

Blocks are groups of about ``BLOCK_ROWS`` rows by a hash of id and vector; queries visit every block in chunks
of their own, so no task holds more than one block and one chunk. A vector that a third of all rows
repeat is spread like any other. Pivots are a bounded sample: ``PIVOTS`` distinct vectors.

Defined cases: vectors null, empty, zero, with null or non-finite components, of another length than
most, or without id take no part; equal rows count once; of an id with several vectors the best score counts, as a query and
as a candidate, and a query's own id takes no part; vectors are scaled by powers of two, so neither tiny nor huge components
leave the range of a double; ties go to the smaller id; with fewer candidates than ``k`` all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 128
ORDERED = 48
SHARE = 0.25
LEAST = 256
BLOCK_ROWS = 16_384
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, v) of the vectors that take part, v in double precision."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad
                     & F.exists("v", lambda x: x != 0)).distinct()


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that their greatest components lie between a half and one: no digit is lost."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """The ``count`` distinct vectors of least hash, or all if there are fewer; copies count once."""
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    picked = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").collect()
    p = scaled(np.array([r.v for r in picked], np.float64))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def representation(unit: np.ndarray, pivot: np.ndarray, ordered: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(unit @ pivot.T), axis=1, kind="stable")[:, :ordered]


def search_block(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivot: np.ndarray,
                 k: int, share: float, least: int) -> list[tuple[int, int, float]]:
    """The ``k`` nearest rows of one block for every query."""
    by_id = np.argsort(ids, kind="stable")
    ids, v, q = ids[by_id], scaled(v[by_id]), scaled(q)
    ordered = min(ORDERED, len(pivot))
    norms, query_norms = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
    order = representation(v / norms[:, None], pivot, ordered)
    posted = np.argsort(order, axis=None, kind="stable")
    rows, places = posted // ordered, posted % ordered
    starts = np.searchsorted(order.ravel()[posted], np.arange(len(pivot) + 1))
    wanted = min(len(ids), max(least, math.ceil(share * len(ids))))
    out = []
    for i, nearest in enumerate(representation(q / query_norms[:, None], pivot, ordered)):
        gain = np.zeros(len(ids), np.int64)
        for place, p in enumerate(nearest):
            at = slice(starts[p], starts[p + 1])
            gain[rows[at]] += ordered - np.maximum(places[at], place)
        rank = gain * len(ids) - np.arange(len(ids))  # ties to the smaller id
        rank[ids == query_ids[i]] = -(1 << 60)
        best = np.argpartition(-rank, wanted - 1)[:wanted]
        best = np.sort(best[ids[best] != query_ids[i]])
        cosine = (v[best] * q[i]).sum(1) / (norms[best] * query_norms[i])
        top = np.lexsort((ids[best], -cosine))
        top = top[np.sort(np.unique(ids[best][top], return_index=True)[1])[:k]]  # an id once
        out += [(int(query_ids[i]), int(ids[best[t]]), float(cosine[t])) for t in top]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vec_col: str = "embedding", share: float = SHARE, least: int = LEAST,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest rows of every query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vec_col)
    sizes = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = every.where(F.size("v") == sizes.d)
    pivot = pivots(every)
    blocks = math.ceil(sizes["count"] / block_rows)
    queries = every.where(is_query)
    chunks = max(1, math.ceil(queries.count() / block_rows))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (every.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
            .withColumn("chunk", grid(chunks)))
    right = (queries.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(chunks)).cast("int"))
             .withColumn("block", grid(blocks)))

    def search(block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        if block.empty or chunk.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(block["id"].to_numpy(np.int64), np.stack(block["v"].to_numpy()),
                             chunk["id"].to_numpy(np.int64), np.stack(chunk["v"].to_numpy()),
                             pivot, k, share, least)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = (left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
             .applyInPandas(search, FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
