"""Links between sets of crowded regions, found exactly by prefixes of rare shingles.

The shingles of each set are put in one order for all sets: rarest first by their number among these sets, then by hash. Sets with a
similarity of at least t share a shingle among the first ``size - ceil(t size) + 1`` of each, and their smallest places there
leave room for the overlap that t asks of the two sizes. Words of a common template are frequent, so they come last and their lists
are hardly ever opened. A list is ordered by size, and a set meets only the sizes that its place allows.

Any order gives the same links; only the ``HEAVY`` most frequent shingles have their numbers sent to the tasks (12 bytes each), the
others count as rare. A list of more than ``LIST`` sets is dealt over blocks of two parts each, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import mixed

HEAVY = 500_000
COMMON = 16
LIST = 20_000
_PART = np.uint64(0x9E3779B97F4A7C15)

ENTRY_DDL = "block long, token long, part int, id long, component long, n int, place int"
PAIR_DDL = "a long, b long"


def _shingle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for full in batch.column("full"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(full.as_buffer(), np.int64))], names=["token"])


def heavy_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of (full), ascending, and their numbers: at most ``HEAVY``."""
    counts = sets.select("full").mapInArrow(_shingle_task, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _entry_task(token: np.ndarray, number: np.ndarray, percent: int):
    """Posts the prefix of every set (id, component, full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, component, full in zip(batch.column("id").to_numpy(), batch.column("component").to_numpy(), batch.column("full")):
                own = np.frombuffer(full.as_buffer(), np.uint64)
                count = np.ones(len(own), np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                    known = token[at] == own
                    count[known] = number[at[known]]
                first = np.lexsort((own, count))[:prefix_length(len(own), percent)]
                parts = -(-count[first] // LIST)
                # a list in one part is a block; of several parts, each meets every part in a block of its own
                post = np.repeat(np.arange(len(first)), parts)
                other = np.arange(len(post)) - np.repeat(np.cumsum(parts) - parts, parts)
                here = (int(mixed(np.array([i], np.int64).view(np.uint64))[0]) % parts.astype(np.uint64)).astype(np.int64)[post]
                names = own[first][post]
                low, high = np.minimum(here, other), np.maximum(here, other)
                block = mixed(mixed(names + low.astype(np.uint64) * _PART) + high.astype(np.uint64))
                k = len(post)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.view(np.int64)), pa.array(names.view(np.int64)), pa.array(here.astype(np.int32)),
                     pa.array(np.full(k, i)), pa.array(np.full(k, component)), pa.array(np.full(k, len(own), np.int32)),
                     pa.array(post.astype(np.int32))],
                    names=["block", "token", "part", "id", "component", "n", "place"])

    return run


def pairs_of_list(part: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray,
                  percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a < b) of one list, sizes ascending: different components, and room for the overlap at the places in the list.

    If the list has two parts, the pairs within a part belong to that part's own block.
    """
    n, left = n.astype(np.int64), (n - place).astype(np.int64)  # of a set, what follows its place and itself
    # the other set's size m >= n must leave: left >= percent (n + m) / (100 + percent)
    last = np.searchsorted(n, (left * (100 + percent)) // percent - n, side="right")
    two = part.max() > part.min()
    a, b = [], []
    for x in np.flatnonzero(last > np.arange(len(n)) + 1):
        y = np.arange(x + 1, last[x])
        y = y[(np.minimum(left[x], left[y]) * (100 + percent) >= percent * (n[x] + n[y])) & (component[x] != component[y])
              & (ids[x] != ids[y])]
        if two:
            y = y[part[y] != part[x]]
        a.append(np.minimum(ids[x], ids[y]))
        b.append(np.maximum(ids[x], ids[y]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _list_task(percent: int):
    """Lists of a partition ordered by block, token and size; each block lies in one partition."""
    columns = ("block", "token", "part", "id", "component", "n", "place")

    def found(rows: pa.Table) -> pa.RecordBatch:
        block, token, part, ids, component, n, place = (rows.column(c).to_numpy() for c in columns)
        starts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (token[1:] != token[:-1])) + 1, [len(block)]])
        out = [pairs_of_list(part[s:e], ids[s:e], component[s:e], n[s:e], place[s:e], percent)
               for s, e in zip(starts[:-1], starts[1:]) if e - s > 1]
        both = np.unique(np.stack([np.concatenate([o[k] for o in out]) for k in (0, 1)], 1), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            block = held.column("block").to_numpy()
            whole = int(np.searchsorted(block, block[-1]))  # blocks ascend
            if whole:
                yield found(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None:
            yield found(held)

    return run


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of (id, component, full) in different components that may reach ``percent``; none that does is missing."""
    entries = sets.select("id", "component", "full").mapInArrow(_entry_task(*heavy_shingles(sets), percent), ENTRY_DDL)
    return (entries.repartition("block").sortWithinPartitions("block", "token", "n", "id")
            .mapInArrow(_list_task(percent), PAIR_DDL).distinct())
