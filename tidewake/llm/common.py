"""What several corpus operators share: column hygiene, scratch tables, text as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake import session


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add, whatever their case."""
    mine = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = session.scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8_size(text: str) -> Column:
    """Bytes of a text in UTF-8; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sample_below(hash_column: str, fraction: float) -> Column:
    """Rows whose 64-bit hash lies in the lowest ``fraction`` of its range."""
    if fraction >= 1:
        return F.lit(True)
    return F.col(hash_column) < F.lit(int(-(2**63) + fraction * 2**64))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A string column as one array with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and where each begins (one more at the end)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def codepoints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind each other, and where each text begins."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, at.copy()
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[at]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        column = strings(batch.column(text))
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


_rng = np.random.default_rng(20240117)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hashes of many spans of one array of symbols, without a loop over the spans."""

    def __init__(self, values: np.ndarray):
        """``values``: a 64-bit value per symbol."""
        self.sums = np.zeros(len(values) + 1, np.uint64)
        weighted = powers(BASE, len(values))
        weighted *= values
        np.cumsum(weighted, out=self.sums[1:])
        del weighted
        self.scale = powers(INVERSE, len(values) + 1)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.scale[begin]
        return mixed(h + (end - begin).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of all words ``[^\\x20\\x09-\\x0D]+``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    change = inside[1:] != inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    begin = np.flatnonzero(inside[1:-1] & (change[:-1] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (change[1:] | cut[1:])) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1
