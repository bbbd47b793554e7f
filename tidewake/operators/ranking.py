"""Exact order statistics by radix selection: the data is never sorted, and scanned twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.functions.frames import evaluated_once
from tidewake.session import counted, stored

# A value's 64 ordered bits are read in three digits; the first has a sign, 11 bits of exponent and 8 of the fraction.
FIRST_SHIFT, SECOND_SHIFT = 44, 22
INFINITE = 2047 << 52


def with_ordered_bits(df: DataFrame, value: str, name: str = "bits") -> DataFrame:
    """Adds a long that orders as the double does: its IEEE bits, negated for negative values; NaN is the greatest.

    Powers of two are exact, so the fraction is too; the logarithm is only a guess of the exponent. In steps, so that
    each term is evaluated once.
    """
    v, a, guess, rest = F.col(value), F.col("_a"), F.col("_guess"), F.col("_rest")
    # greatest and least skip nulls, and the logarithm of 0 is one
    exponent = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.coalesce(F.floor(F.log2(a)).cast("double"), F.lit(-1022.0))))
    steps = (df.withColumn("_a", F.abs(v)).withColumn("_guess", exponent)
             .withColumn("_rest", a / F.pow(F.lit(2.0), guess)))
    low = (rest < 1) & (guess > -1022)
    shift = F.when(rest >= 2, 1).when(low, -1).otherwise(0)
    fraction = F.when(rest >= 2, rest / 2).when(low, rest * 2).otherwise(rest)
    finite = (guess.cast("long") + shift + 1022) * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long")
    bits = F.when(F.isnan(v), F.lit(INFINITE + 1)).when(a == float("inf"), F.lit(INFINITE)).otherwise(finite)
    return steps.withColumn(name, F.when(v < 0, -bits).otherwise(bits)).drop("_a", "_guess", "_rest")


def _hits(parts: DataFrame, wanted: list[tuple[str, str, int, int]]) -> list:
    """For each rank (name, slot so far, k, rows below that slot) the part of its slot that holds it, and the rows below that.

    ``parts`` are (slot, part, c, v): what a task orders is bounded by the width of a digit.
    """
    upto = F.sum("c").over(W.partitionBy("slot").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parts.withColumn("upto", upto)
    fields = ("name", "slot", "k", "below")
    ranks = F.array(*[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, w)]) for w in wanted])
    each = placed.select("*", F.explode(ranks).alias("r")).where("r.slot = slot")
    inside = F.col("r.k") - F.col("r.below")
    return each.where((inside < F.col("upto")) & (inside >= F.col("upto") - F.col("c"))).select(
        F.col("r.name").alias("name"), "part", F.col("r.k").alias("k"),
        (F.col("r.below") + F.col("upto") - F.col("c")).alias("below"), "v").collect()


def rank_select(values: DataFrame, value: str, ranks: dict[str, Column],
                weight: str | None = None) -> DataFrame:
    """Exact k-th smallest values: rows ``(rank_name, k, value)``.

    ``ranks`` maps a name to a column expression over ``n`` (the number of rows), giving the
    0-based rank. ``weight`` names a count column when the input is already a histogram.

    The first scan counts rows by the leading digit of the ordered bits (at most 2^20 counters, summed up in each task); the
    second groups the distinct values in the slots that hold a wanted rank and writes them. The
    rest is settled on that table, in one more digit if its values are many. What a single task sees is bounded by the digits, not by
    the rows, whatever share of them one value holds.

    Both scans run when this is called; ``values`` should be cheap to read: one column of stored files.
    """
    spark = values.sparkSession
    schema = "rank_name string, k long, value double"
    rows = evaluated_once(values.select(F.col(value).cast("double").alias("v"),
                                        (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")))
    rows = with_ordered_bits(rows.where("v is not null"), "v")
    first = F.shiftright("bits", FIRST_SHIFT)
    slots = rows.groupBy(first.alias("part")).agg(F.sum("w").alias("c"))
    whole = W.orderBy("part")
    placed = slots.select("part", "c", F.sum("c").over(whole).alias("upto"),
                            F.sum("c").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in ranks.items()])
    found = (placed.select("*", F.explode(places).alias("r")).where("r.k < upto and r.k >= upto - c")
             .select("r.name", "part", "r.k", (F.col("upto") - F.col("c")).alias("below")).collect())
    if not found:
        return spark.createDataFrame([], schema)
    slots = sorted({r.part for r in found})
    near, seen = counted(rows.where(first.isin(slots)).groupBy("bits").agg(F.min("v").alias("v"), F.sum("w").alias("c")))
    near = stored(near, "ranks")
    # a task orders the values of a slot: as many as a digit has, unless they are fewer
    digits = (FIRST_SHIFT, 0) if seen.get["n"] <= 1 << 20 else (FIRST_SHIFT, SECOND_SHIFT, 0)
    for outer, inner in zip(digits, digits[1:]):
        slot = F.shiftright("bits", outer)
        parts = (near.select(slot.alias("slot"), F.shiftright("bits", inner).alias("part"), "c", "v")
                 .where(F.col("slot").isin(sorted({r.part for r in found})))
                 .groupBy("slot", "part").agg(F.sum("c").alias("c"), F.min("v").alias("v")))
        found = _hits(parts, [(r.name, r.part, r.k, r.below) for r in found])
    return spark.createDataFrame([(r.name, r.k, r.v) for r in found], schema)


def interpolated(values: DataFrame, value: str, fraction: float,
                 weight: str | None = None) -> DataFrame:
    """One row ``(value)``: the linearly interpolated percentile; NULL when there are no rows."""
    at = (F.col("n") - 1) * F.lit(float(fraction))
    picked = rank_select(values, value, {"low": F.floor(at), "high": F.ceil(at)}, weight)
    known = F.col(value).isNotNull()
    n = values.agg((F.sum(F.when(known, F.col(weight))) if weight else F.count(value)).alias("n")).scalar()
    low = F.max(F.when(F.col("rank_name") == "low", F.col("value")))
    high = F.max(F.when(F.col("rank_name") == "high", F.col("value")))
    share = (n - 1) * F.lit(float(fraction))
    both = picked.agg(low.alias("low"), high.alias("high"))
    return both.select((F.col("low") + (F.col("high") - F.col("low"))
                        * (share - F.floor(share))).alias("value"))
