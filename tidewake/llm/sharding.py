"""Two-pass external shuffle of records into numbered shards of equal row counts.

First pass: a seeded hash of id and text scatters the records uniformly into buckets small enough
for memory; their number follows from the bytes of the table. Second pass: every bucket is put into
a canonical order, shuffled by Fisher-Yates with a generator seeded by (seed, bucket), and written.
A row's place in the whole is the number of rows in earlier buckets plus its place in its bucket;
shards are equal cuts of these places, so their counts differ by one at most.

Defined cases: a null text has no bytes; a null id is scattered by its text; repeated rows are all
kept, each with a slot of its own; an empty table gives an empty folder; input columns named like
those added here (``size``, ``shard``, ``slot``) are replaced. Bounds: a bucket holds about
``bucket_bytes``, save that rows equal in id and text share one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import fresh, utf8_size, without

SHARDS = 40
SEED = 20240117
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16


def written_schema(docs: DataFrame) -> T.StructType:
    """What ``shuffled`` and the written files have: the rows' own columns and the three added ones."""
    return T.StructType([*without(docs, "size", "shard", "slot").schema.fields,
                         T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()),
                         T.StructField("slot", T.LongType())])


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``size``, ``shard`` and ``slot``, in a seeded random order."""
    schema = written_schema(docs)
    docs = without(docs, "size", "shard", "slot")
    docs = docs.withColumn("size", utf8_size(text_col) + F.lit(ROW_BYTES))
    key, crc = fresh(docs, "bucket"), fresh(docs, "crc")
    total = docs.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    rows, buckets = total.n, max(1, math.ceil((total.b or 0) / bucket_bytes))

    scatter = F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(buckets))
    records = docs.withColumn(key, scatter).withColumn(crc, F.crc32(F.coalesce(text_col, F.lit(""))))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, not per record.
    offsets = (records.groupBy(key).agg(F.count("*").alias("n"))
               .select(key, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset")))
    starts = np.array([-(-s * rows // shards) for s in range(shards + 1)], np.int64)

    def second_pass(part: pa.Table, offset: pa.Table) -> pa.Table:
        bucket, first = offset.column(key)[0].as_py(), offset.column("offset")[0].as_py()
        order = pc.sort_indices(part, sort_keys=[(id_col, "ascending"), (crc, "ascending")]).to_numpy()
        part = part.drop_columns([key, crc]).take(pa.array(order))
        # numpy's permutation is a Fisher-Yates shuffle
        moved = np.random.default_rng([seed, bucket]).permutation(len(part))
        place = first + np.arange(len(part), dtype=np.int64)
        shard = np.searchsorted(starts, place, side="right") - 1
        return (part.take(pa.array(moved))
                .append_column("shard", pa.array(shard.astype(np.int32)))
                .append_column("slot", pa.array(place - starts[shard])))

    return records.groupBy(key).cogroup(offsets.groupBy(key)).applyInArrow(second_pass, schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records below ``path``, a folder per shard, rows of a file in slot order."""
    (shuffled(docs, **options).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
