"""Near-duplicates of whole texts by an LSH forest over MinHash signatures.

A text's set are its distinct shingles of ``words`` words. Equal sets are collapsed first, so a text
that thousands of documents copy takes part once. Each set gets ``HASHES`` MinHash values. ``TREES``
sorted orders read them from different places: a tree's label is the sequence of values from there.
Labels are sorted; sets with a common prefix of ``FIRST`` values form a region. A region of up to
``CROWD`` sets gives all its pairs; a more crowded one is split by the next value, down to
``FIRST + DEEPER``, and what is still crowded there (nearly equal signatures) is linked along the order,
``NEAR`` neighbours each way. Next neighbours of a region are candidates at any depth.

A pair with similarity 0.8 shares 3 values in one tree of 32 but for one case in 10 ** 10. Where such a region is crowded, what
is found along its order only joins most of it; the rest is decided exactly below. A candidate must agree in enough 2-bit
remainders of the values (five standard deviations of a pair at the threshold allowed for), and is confirmed on the full sets.

Confirming moves whole sets, so it goes in two rounds: each set's best candidate and its smallest likely one, which joins most of
a large group, then what is still in different components, which are contracted to one node each. In the second round the crowded regions (more than ``CROWD`` sets with ``FIRST``
values in common) are gone through whole: ``crowds.candidates`` finds all their pairs that may reach the threshold by
prefixes of rare shingles, so a family on one template costs what its sets have in common beside the template.

The order is range-partitioned by label and set, so a crowded region is spread over tasks; the rows on both sides of
each cut are paired in a second, small job. Components come from ``graph.components``.

Defined cases: a null, empty or blank text has an empty set, is linked with nothing and kept; fewer
words than a shingle are one shingle; a null id is linked with nothing; each repeated row is returned;
an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm import crowds, graph
from tidewake.llm.common import LOWER, BYTE_VALUES, Hasher, blocks, mixed, raw, stored, strings, words

HASHES, TREES = 128, 32
FIRST, DEEPER = 3, 5
CROWD, NEAR = 16, 2
BLOCK = 1 << 20
BROADCAST_IDS = 4_000_000  # ids of 8 bytes: 32 MB
BROADCAST_CELLS = 500_000  # of 40 bytes: 20 MB

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_WORD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, ascending within each, and where each text begins."""
    data = LOWER[data]
    begin, end, owner = words(data, at)
    texts = len(at) - 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    h = Hasher(BYTE_VALUES[data]).spans(begin, end)
    n = len(h) - k + 1
    if n > 0:
        whole = np.flatnonzero(owner[:n] == owner[k - 1:])
        sums = np.zeros(len(whole), np.uint64)
        for j in range(k):
            sums += h[whole + j] * _WORD[j]
        shingles, of = mixed(sums), owner[whole]
    else:
        shingles, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=texts)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = [mixed((h[f:f + c] * _WORD[:c]).sum(keepdims=True) + _WORD[-c])[0]
                 for f, c in zip(first, count[short])]
        shingles, of = np.concatenate([shingles, np.array(extra, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
    shingles, of = shingles[new], of[new]
    return shingles, np.searchsorted(of, np.arange(texts + 1))


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty sets that begin at ``starts``."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES):
        values = ((shingles * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)
        out[:, j] = np.minimum.reduceat(values, starts)
    return out


SKETCH_DDL = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def _sketch_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            data, at = raw(strings(part.column("text")))
            shingles, start = shingle_sets(data, at, k)
            n = np.diff(start)
            full = np.flatnonzero(n)
            set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signature = [b""] * len(n)
            if len(full):
                set_a[full] = np.add.reduceat(shingles, start[full])
                set_b[full] = np.add.reduceat(mixed(shingles + np.uint64(1)), start[full])
                for i, values in zip(full, signatures(shingles, start[full])):
                    signature[i] = values.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(set_a.view(np.int64)),
                 pa.array(set_b.view(np.int64)), pa.array(signature, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return run


def sketches(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """Per row of (doc_id, text): the size of its set, two hashes of the whole set, its signature."""
    return docs.mapInArrow(_sketch_task(words_per_shingle), SKETCH_DDL)


def _cells(sign: np.ndarray) -> np.ndarray:
    """Per set and tree a hash of the tree and its first values."""
    out = np.empty((len(sign), TREES), np.int64)
    for tree in range(TREES):
        head = sign[:, (tree * (HASHES // TREES) + np.arange(FIRST)) % HASHES].astype(np.uint64)
        cell = np.full(len(sign), tree + 1, np.uint64)
        for j in range(FIRST):
            cell = mixed(cell * _WORD[0] + head[:, j])
        out[:, tree] = cell.view(np.int64)
    return out


def _packed_bits(sign: np.ndarray) -> np.ndarray:
    """The 2-bit remainders of the values, four a byte."""
    low = (sign & 3).astype(np.uint8).reshape(len(sign), -1, 4)
    return (low[:, :, 0] | low[:, :, 1] << 2 | low[:, :, 2] << 4 | low[:, :, 3] << 6).astype(np.uint8)


TREE_DDL = "cell long, label binary, rep long, n int, bits binary"


def _tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's label in each tree: a hash of tree and first values, the next ones, and the remainders."""
    for batch in batches:
        if not len(batch):
            continue
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        rep = batch.column("rep").to_numpy()
        n = batch.column("n_shingles").to_numpy().astype(np.int32)
        packed, cells = pa.array([row.tobytes() for row in _packed_bits(sign)], pa.binary()), _cells(sign)
        for tree in range(TREES):
            order = (tree * (HASHES // TREES) + np.arange(FIRST + DEEPER)) % HASHES
            tail = (sign[:, order[FIRST:]] >> 16).astype(">u2")
            labels = pa.array([row.tobytes() for row in tail], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[:, tree].copy()), labels, pa.array(rep), pa.array(n), packed],
                names=["cell", "label", "rep", "n", "bits"])


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many 2-bit remainders two packed rows agree."""
    differ = a ^ b
    return HASHES - np.bitwise_count((differ | (differ >> 1)) & 0x55).sum(axis=1, dtype=np.int64)


def expected(similarity: float) -> int:
    """The expected agreement in 2-bit remainders of a pair with this similarity."""
    return math.floor(HASHES * (similarity + (1 - similarity) / 4))


def enough(similarity: float) -> int:
    """The least agreement in 2-bit remainders, five standard deviations below the expected one."""
    p = similarity + (1 - similarity) / 4
    return math.floor(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p)))


def region_pairs(cell: np.ndarray, label: np.ndarray, rep: np.ndarray, n: np.ndarray, bits: np.ndarray,
                 percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (a < b, agreement) among rows sorted by cell and label."""
    size = len(cell)
    change = np.ones(size, bool)
    change[1:] = cell[1:] != cell[:-1]
    in_cell = np.cumsum(change)
    region = np.full(size, -1, np.int64)
    width = np.zeros(size, np.int64)
    open_ = np.ones(size, bool)
    for depth in range(DEEPER + 1):
        if depth:
            change[1:] |= label[1:, depth - 1] != label[:-1, depth - 1]
        group = np.cumsum(change) - 1
        counts = np.bincount(group)[group]
        settled = open_ & ((counts <= CROWD) | (depth == DEEPER))
        # rows of one group settle together: its members were all open in the crowded one above
        region[settled] = group[settled] * (DEEPER + 1) + depth
        width[settled] = np.where(counts[settled] <= CROWD, CROWD, NEAR)
        open_ &= ~settled
        if not open_.any():
            break
    left, right, agree = [], [], []
    least = enough(percent / 100)
    for step in range(1, min(CROWD, size)):
        same = (region[step:] == region[:-step]) & (width[:-step] >= step)
        if step == 1:
            same |= in_cell[1:] == in_cell[:-1]
        i = np.flatnonzero(same)
        j = i + step
        i_n, j_n = n[i].astype(np.int64), n[j].astype(np.int64)
        fits = (100 * np.minimum(i_n, j_n) >= percent * np.maximum(i_n, j_n)) & (rep[i] != rep[j])
        i, j = i[fits], j[fits]
        common = _agreeing(bits[i], bits[j])
        i, j, common = i[common >= least], j[common >= least], common[common >= least]
        left.append(np.minimum(rep[i], rep[j]))
        right.append(np.maximum(rep[i], rep[j]))
        agree.append(common)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


CANDIDATE_DDL = "a long, b long, agree int, cut int, cell long, label binary, rep long, n int, bits binary"
_ROW = ("cell", "label", "rep", "n", "bits")


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    labels = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u2").reshape(-1, DEEPER)
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, HASHES // 4)
    return (table.column("cell").to_numpy(), labels, table.column("rep").to_numpy(),
            table.column("n").to_numpy(), bits)


def _pairs_out(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(agree.astype(np.int32)), *empty],
                                      names=["a", "b", "agree", "cut", *_ROW])


def _edge_out(rows: pa.Table, cut: int) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
               pa.array(np.full(n, cut, np.int32)), *(rows.column(c).combine_chunks() for c in _ROW)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "agree", "cut", *_ROW])


def _counts_out(cell: np.ndarray) -> pa.RecordBatch:
    """Sizes of the crowded cells of a slice, and of the first and last, which may go on elsewhere."""
    cells, counts = np.unique(cell, return_counts=True)
    take = counts > CROWD
    take[[0, -1]] = True
    n = int(take.sum())
    empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*empty, pa.array(cells[take]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
         pa.array(counts[take].astype(np.int32)), pa.nulls(n, pa.binary())], names=["a", "b", "agree", "cut", *_ROW])


def _candidate_task(percent: int, chunk: int = 50_000):
    """Walk a sorted partition in chunks of whole cells (a larger cell overlaps by ``CROWD`` rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held, tail, started = None, None, False
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if not started:
                started = True
                yield _edge_out(table.slice(0, CROWD), here)
            tail = pa.concat_tables([tail, table]) if tail is not None else table
            tail = tail.slice(max(0, len(tail) - CROWD))
            held = table if held is None else pa.concat_tables([held, table])
            cell = held.column("cell").to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # cells ascend
            if whole:
                yield _pairs_out(*region_pairs(*_arrays(held.slice(0, whole)), percent))
                yield _counts_out(cell[:whole])
                held = held.slice(whole).combine_chunks()
            if len(held) > chunk:
                yield _pairs_out(*region_pairs(*_arrays(held), percent))
                yield _counts_out(held.column("cell").to_numpy())
                held = held.slice(len(held) - CROWD).combine_chunks()
        if held is not None and len(held):
            yield _pairs_out(*region_pairs(*_arrays(held), percent))
            yield _counts_out(held.column("cell").to_numpy())
            yield _edge_out(tail, here + 1)

    return run


def candidates(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b, agree) of (rep, n_shingles, signature), and the crowded cells."""
    spark = reps.sparkSession
    trees = reps.select("rep", "n_shingles", "signature").mapInArrow(_tree_task, TREE_DDL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = trees.repartitionByRange(parts, "cell", "label", "rep").sortWithinPartitions("cell", "label", "rep")
    found = stored(order.mapInArrow(_candidate_task(percent), CANDIDATE_DDL), "candidates")

    def across(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("cell", "label", "rep")])
        a, b, agree = region_pairs(*_arrays(rows), percent)
        return pa.table({"a": a, "b": b, "agree": agree.astype(np.int32)})

    # CROWD rows on either side of each cut between partitions
    seams = (found.where("cut is not null").select("cut", *_ROW).groupBy("cut")
             .applyInArrow(across, "a long, b long, agree int"))
    pairs = found.where("a is not null").select("a", "b", "agree").union(seams)
    crowded = (found.where("a is null and cut is null").groupBy("cell").agg(F.sum("n").alias("n"))
               .where(F.col("n") > CROWD).select("cell"))
    return pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), crowded


def among(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (or, with ``left_anti``, is not) in ``ids``; broadcast up to a checked size."""
    ids = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def _set_task(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            data, at = raw(strings(part.column("text")))
            shingles, start = shingle_sets(data, at, k)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"),
                 pa.array([shingles[s:e].tobytes() for s, e in zip(start[:-1], start[1:])], pa.binary())],
                names=["id", "full"])

    return run


def _confirm_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("full_a"), batch.column("full_b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) that hold on the full sets (id, full)."""
    return (pairs.select("a", "b", "ca", "cb")
            .join(sets.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b")
            .mapInArrow(_confirm_task(percent), "a long, b long, ca long, cb long"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components, with these as ca < cb."""
    out = pairs
    for end in ("a", "b"):
        part = comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        out = out.drop(f"c{end}").join(part, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return out.where("ca <> cb").select("a", "b", "ca", "cb")


def _cell_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_cells(sign).ravel()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sign))),
                 pa.array(np.repeat(batch.column("rep").to_numpy(), TREES))], names=["cell", "tree", "rep"])


def in_live_cells(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, component) of the members (cell, rep) of cells with more than one component."""
    placed = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "cell", "rep", F.coalesce("component", "rep").alias("component"))
    live = (placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high").select("cell"))
    return placed.join(live, "cell").select(F.col("rep").alias("id"), "component").distinct()


def linked(reps: DataFrame, texts: DataFrame, percent: int, words_per_shingle: int) -> DataFrame:
    """(node, component) of the sets that are linked with another one."""
    pairs, crowded = candidates(reps, percent)
    pairs = stored(pairs, "pairs")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded
    members = stored(reps.select("rep", "signature").mapInArrow(_cell_task, "cell long, tree int, rep long")
                     .select("cell", "rep").join(crowded, "cell"), "members")
    ends = pairs.select("a").union(pairs.select("b")).union(members.select("rep"))
    needed = among(texts, ends).dropDuplicates(["doc_id"])
    sets = stored(needed.mapInArrow(_set_task(words_per_shingle), "id long, full binary"), "sets")

    end = F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("b").alias("other")),
                            F.struct(F.col("b").alias("end"), F.col("a").alias("other"))))
    likely = F.when(F.col("agree") >= expected(percent / 100), F.col("e.other"))
    picked = pairs.select(end.alias("e"), "agree").groupBy("e.end").agg(
        F.max_by("e.other", F.struct("agree", -F.col("e.other"))).alias("best"), F.min(likely).alias("low"))
    first = (picked.select("end", F.explode(F.array("best", "low")).alias("other")).where("other is not null")
             .select(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("b")).distinct()
             .select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    comps = stored(graph.components(confirmed(first, sets, percent).select("a", "b")), "components")

    crowd = stored(sets.join(in_live_cells(members, comps), "id"), "crowd")
    rest = pairs.select("a", "b").union(crowds.candidates(crowd, percent)).distinct()
    links = confirmed(stored(_apart(rest, comps), "rest"), sets, percent)
    joined = stored(graph.components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
    onward = joined.select(F.col("node").alias("component"), F.col("component").alias("last"))
    return (comps.join(onward, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
            .union(joined.join(comps, "node", "left_anti").select("node", "component")))


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Links are pairs of texts with ``100 * |intersection| >= percent * |union|``; the component is named by
    its smallest id, and that document is kept.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(sketches(texts, words_per_shingle), "sketches")
    groups = (sketch.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
              .agg(F.min("doc_id").alias("rep")))
    key = ["set_a", "set_b", "n_shingles"]
    reps = stored(sketch.withColumnRenamed("doc_id", "rep").join(groups, [*key, "rep"], "left_semi")
                  .dropDuplicates([*key, "rep"]), "reps")
    comps = linked(reps, texts, percent, words_per_shingle)
    final = (reps.select(*key, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .select(*key, F.coalesce("component", "rep").alias("component_id")))
    return (sketch.drop("signature").join(final, key, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))))


def one_of_each(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component, and once each row that is repeated with id and text."""
    links = near_duplicates(docs, words_per_shingle, percent, id_col, text_col)
    kept = among(docs, links.where("not kept").select("doc_id"), id_col, "left_anti")
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).count()
                   .where("count > 1").select("id"), "again")
    if again.isEmpty():
        return kept
    repeated = among(kept, again, id_col).dropDuplicates([id_col, text_col])
    return among(kept, again, id_col, "left_anti").unionByName(repeated.select(*kept.columns))
