"""Length buckets with the least padding, and token-budget batches inside each bucket.

A global histogram of lengths feeds a dynamic program that picks ``buckets`` boundaries; every
document is padded to its bucket's boundary. Inside a bucket documents are numbered and cut into
batches of ``budget // boundary`` documents, one at least.

The histogram is exact up to 1024 and keeps ``1 / 512`` relative precision beyond, so it has at most
1024 + 512 * 54 rows for any lengths; every bin remembers its greatest length, and padding is
computed from exact counts and sums. With all lengths up to 1024 the boundaries are optimal.

Numbering needs no global sort: documents fall into (bucket, cell) groups of about ``CELL_ROWS`` rows
by a hash, are numbered there, and a running count of the cells gives each its offset, so a
bucket with most of the documents is spread over all tasks.

Defined cases: a null or empty text has length 1 (the end mark); repeated rows each take a place;
an empty table gives no rows; input columns named like those added here are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import fresh, utf8_size, without

BUCKETS = 16
BUDGET = 262_144
CELL_ROWS = 50_000
EXACT, PRECISION = 1024, 512
ADDED = ("length", "bucket", "boundary", "batch", "slot", "padding")


def byte_length(text: str = "text") -> Column:
    """Tokens of a byte-level model: the UTF-8 bytes and an end mark."""
    return utf8_size(text) + F.lit(1)


def _bin(length: Column) -> Column:
    """Bins of one length up to ``EXACT``, then ``PRECISION`` bins per doubling."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - math.log2(PRECISION)).cast("long")
    return F.when(length <= EXACT, length).otherwise(length - length % F.greatest(step, F.lit(1)))


def histogram(lengths: DataFrame) -> DataFrame:
    """Count, sum and greatest length per bin of column ``length``."""
    return lengths.groupBy(_bin(F.col("length")).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("length").alias("total"), F.max("length").alias("top"))


def best_boundaries(top: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Boundaries among ``top`` (ascending) with the least sum of padding, by dynamic programming."""
    bins = len(top)
    if not bins:
        return []
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    # cost[j]: least padding of the first j bins with the buckets used so far
    cost = np.full(bins + 1, np.inf)
    cost[0] = 0
    choice = []
    for _ in range(min(buckets, bins)):
        new, pick = cost.copy(), np.full(bins + 1, -1)
        for j in range(1, bins + 1):
            padded = cost[:j] + top[j - 1] * (count[j] - count[:j]) - (mass[j] - mass[:j])
            i = int(np.argmin(padded))
            if padded[i] < new[j]:
                new[j], pick[j] = padded[i], i
        cost = new
        choice.append(pick)
    out, j = [], bins
    for pick in reversed(choice):
        if j and pick[j] >= 0:
            out.append(int(top[j - 1]))
            j = int(pick[j])
    return sorted(out)


def boundaries(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The best boundaries for column ``length``; the histogram is bounded, see the module."""
    rows = sorted(histogram(lengths).collect())
    top, n, total = (np.array([r[k] for r in rows], np.float64) for k in ("top", "n", "total"))
    return best_boundaries(top, n, total, buckets)


def assign_batches(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS,
                   budget: int = BUDGET, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with length, bucket, boundary, batch (within the bucket), slot and padding."""
    length = byte_length() if length is None else length
    name = fresh(docs, "length")
    docs = without(docs.withColumn(name, length.cast("long")), *ADDED).withColumnRenamed(name, "length")
    limits = boundaries(docs.select("length"), buckets)
    rows = docs.count()
    edges = limits or [1]
    bucket = sum((F.when(F.col("length") > F.lit(b), 1).otherwise(0) for b in edges[:-1]), F.lit(0))
    cell, spread, offset = (fresh(docs, c) for c in ("cell", "spread", "offset"))
    docs = (docs.withColumn("bucket", bucket.cast("int"))
            .withColumn(spread, F.xxhash64(F.lit(7), id_col, "length"))
            .withColumn(cell, F.pmod(spread, F.lit(max(1, math.ceil(rows / CELL_ROWS))))))
    earlier = Window.partitionBy("bucket").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (docs.groupBy("bucket", cell).agg(F.count("*").alias("n"))
               .select("bucket", cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(offset)))
    within = Window.partitionBy("bucket", cell).orderBy(spread, id_col)
    numbered = docs.withColumn("slot", F.row_number().over(within)).join(offsets, ["bucket", cell])
    place = F.col(offset) + F.col("slot") - 1
    boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in edges]), F.col("bucket") + 1)
    room = F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1))
    return (numbered.withColumn("boundary", boundary)
            .withColumns({"batch": F.floor(place / room).cast("long"), "slot": (place % room).cast("int"),
                          "padding": F.col("boundary") - F.col("length")})
            .select(*[F.col(f"`{c}`") for c in docs.columns if c not in (cell, spread, "length", "bucket")],
                    *ADDED))
