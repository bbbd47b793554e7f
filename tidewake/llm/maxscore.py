"""Exact top-k search by integer inner product, with MaxScore over signed components.

The terms of a vector are its components: component ``d`` of a positive vector weight is posted under ``(d, +)``, of a negative one
under ``(d, -)``. Only the list of a query component's own sign can add to the score; its bound is the product with the
greatest weight posted there. In a shard, the rows at the head of the query's strongest list give a first threshold. Terms whose
bounds together stay below the threshold are non-essential: a row posted in no other list cannot be among the best. The
essential lists are traversed; the rows found are probed for their other components, strongest first, and dropped as soon as
what is still open cannot lift them to the threshold. The best ``k`` ids of all shards are merged.

Shards are groups of about ``SHARD_CELLS`` components by a hash of id and vector, and queries come in chunks, so a task
holds one shard and one chunk; a vector or id that a third of the rows repeat is spread or collapsed. With dense
vectors most rows are in some essential list; what MaxScore saves is the probing. A set share of rows as queries makes
the work grow with the square of the table.

Defined cases: equal rows count once; of an id with several vectors the best score counts, as a query and as a candidate,
and a query's own id takes no part; a vector shorter than another lacks its further components; vectors without id, null,
or with null or non-finite components (after the scaling) take no part; an empty vector scores 0; scores beyond 64
bits are cut to the range of a long before they are ranked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024.0
SHARD_CELLS = 1 << 18
CHUNK_CELLS = 1 << 18
FOUND = "query_id long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct (id, v) that take part; v are the integers ``floor(SCALE * x)``, still as doubles."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(
        F.col(vec_col).cast("array<double>"), lambda x: F.lit(SCALE) * x).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).distinct()


def whole(vectors: list[np.ndarray], exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of all vectors behind each other, where each begins, and its length."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    flat = np.floor(np.concatenate([np.asarray(v, np.float64) for v in vectors])) if sizes.sum() else np.zeros(0)
    weights = flat.astype(np.int64) if exact else np.array([int(x) for x in flat], object)
    return weights, np.cumsum(sizes) - sizes, sizes


def fits(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether no inner product of the two sides can leave 62 bits."""
    most = lambda side: max((float(np.abs(v).max()) + 1 for v in side if len(v)), default=0.0)
    return most(a) * most(b) * max((len(v) for v in b), default=0) < 2.0 ** 62


class Shard:
    """Rows of one shard: weights by row, and postings by component and sign, heaviest first."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], exact: bool):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.weights, self.begin, self.sizes = whole([vectors[i] for i in order], exact)
        row = np.repeat(np.arange(len(ids)), self.sizes)
        dim = np.arange(len(row)) - self.begin[row]
        signed = [(self.weights > 0, 1), (self.weights < 0, -1)]
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for mask, sign in signed:
            mask = mask.astype(bool)
            rows, dims, heavy = row[mask], dim[mask], np.abs(self.weights[mask])
            by = np.lexsort((-heavy, dims))
            rows, dims, heavy = rows[by], dims[by], heavy[by]
            for d, first, last in zip(*bounds(dims)):
                self.lists[int(d), sign] = rows[first:last], heavy[first:last]

    def component(self, rows: np.ndarray, d: int) -> np.ndarray:
        """Weights of ``rows`` at component ``d``; 0 beyond their ends."""
        inside = self.sizes[rows] > d
        if inside.all():
            return self.weights[self.begin[rows] + d]
        out = np.zeros(len(rows), self.weights.dtype)
        out[inside] = self.weights[self.begin[rows[inside]] + d]
        return out

    def best(self, score: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Greatest scores with their ids, an id once; ties to the smaller id."""
        if score.dtype == object:
            score = np.array([min(max(int(x), LONG[0]), LONG[1]) for x in score], object)
        order = np.lexsort((self.ids[rows], -score))
        score, ids = score[order], self.ids[rows][order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return score[first], ids[first]

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best ids of the shard for one query, without its own id."""
        others = self.ids != own
        terms = [(int(w), d, *self.lists[d, 1 if w > 0 else -1]) for d, w in enumerate(q)
                 if w and (d, 1 if w > 0 else -1) in self.lists]
        terms = sorted(((abs(w) * int(heavy[0]), w, d, rows, heavy) for w, d, rows, heavy in terms), key=lambda t: t[:3])
        threshold = None
        if terms:  # heads of the strongest list, scored in full
            head = terms[-1][3][:4 * k]
            head = head[others[head]]
            score = sum((int(w) * self.component(head, d) for d, w in enumerate(q) if w), self.zeros(len(head)))
            top = self.best(score, head, k)[0]
            threshold = int(top[-1]) if len(top) == k and top[-1] > LONG[0] else None
        if threshold is None or threshold <= 0:  # rows posted nowhere may be among the best
            essential, open_, seen = terms, 0, others.copy()
        else:
            reach, weak = 0, 0
            while weak < len(terms) and reach + terms[weak][0] < threshold:
                reach += terms[weak][0]
                weak += 1
            essential, open_, seen = terms[weak:], reach, np.zeros(len(self.ids), bool)
        score = self.zeros(len(self.ids))
        for _, w, _, rows, heavy in essential:
            score[rows] += abs(w) * heavy
            seen[rows] = True
        rows = np.flatnonzero(seen & others)
        score = score[rows]
        added = {d: w for _, w, d, _, _ in essential}
        gain = {d: bound for bound, _, d, _, _ in terms if d not in added}
        # what is left: components of non-essential lists, and all that take away
        for d in sorted((d for d, w in enumerate(q) if w), key=lambda d: (-abs(int(q[d])), d)):
            if threshold is not None:
                alive = score + open_ >= threshold
                rows, score = rows[alive], score[alive]
            part = int(q[d]) * self.component(rows, d)
            score = score + (np.minimum(part, 0) if d in added else part)
            open_ -= gain.get(d, 0)
        return self.best(score, rows, k)

    def zeros(self, n: int) -> np.ndarray:
        return np.zeros(n, self.weights.dtype) if self.weights.dtype != object else np.array([0] * n, object)


def bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins and ends."""
    kinds, first = np.unique(values, return_index=True)
    return kinds, first, np.append(first[1:], len(values))


def search_shard(ids: np.ndarray, vectors: list, query_ids: np.ndarray, queries: list, k: int) -> pd.DataFrame:
    exact = fits(vectors, queries)
    shard = Shard(ids, vectors, exact)
    weights, begin, sizes = whole(queries, exact)
    out = []
    for own, b, n in zip(query_ids, begin, sizes):
        score, found = shard.search(int(own), weights[b:b + n], k)
        out += [(int(own), int(i), int(s)) for s, i in zip(score, found)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
        shard_cells: int = SHARD_CELLS, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """The ``k`` best ids of every query: query_id, rank, vec_id, score. ``is_query`` is a condition on the column ``id``."""
    every = usable(vectors, id_col, vec_col)
    asked = F.coalesce(is_query, F.lit(False))
    cells, rows = F.sum(F.size("v") + 1), F.count(F.lit(1))
    size = every.agg(cells.alias("all"), F.sum(F.when(asked, F.size("v") + 1)).alias("asked"), rows.alias("n")).first()
    if not size["asked"]:
        return vectors.sparkSession.createDataFrame([], RESULT)
    shards, chunks = math.ceil(size["all"] / shard_cells), math.ceil(size["asked"] / chunk_cells)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    left = every.withColumn("shard", place(1, shards)).withColumn("chunk", grid(chunks))
    right = every.where(asked).withColumn("chunk", place(2, chunks)).withColumn("shard", grid(shards))

    def search(shard: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or chunk.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_shard(shard["id"].to_numpy(np.int64), list(shard["v"]), chunk["id"].to_numpy(np.int64), list(chunk["v"]), k)

    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(search, FOUND)
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH part AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS d FROM part),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM cell q JOIN cell c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pair QUALIFY rank <= 10"""
