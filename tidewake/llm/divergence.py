"""How the sources of each language differ in their words, by three-dimensional cube partitioning.

Terms are runs of letters A-Z and of characters beyond ASCII, in lower case (A-Z only). A language keeps the ``V`` terms that occur
in at least ``LEAST_DOCS`` of its documents. A group (language, source) with ``N`` occurrences of kept terms gives each of them
``p = 1 + floor(10**9 * (count + 5) / (N + 5 V))``; the language as a whole likewise. All arithmetic is on integers.

Documents are counted in their task, and only (language, source, term) sums are shuffled. Groups are dealt into blocks of about
``GROUPS`` and terms into blocks of about ``TERMS``. A task owns a cell (group block, group block, term block): it gets the slices
(group block, term block) of both sides, which are replicated along the third axis, and gives the partial sum of ``|p - q|``
for each pair of its groups, the cells on the diagonal also the best terms of each group. The partial sums are added up, and the best terms
merged, along the term axis. A term that neither side of a cell holds adds the same for a pair, so slices list only the terms that
occur, and each cell is told how many terms its block has.

Bounds: a cell holds two slices of ``GROUPS`` by ``TERMS`` numbers. The pairs of sources of a language are the result itself.

Defined cases: null text, language and source are empty strings; a group without terms has count 0 for all; a language without
kept terms has ``V`` = 0, pairs of value 0 and no terms; repeated rows count each time; a very long text is cut into pieces
between terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import stored, strings

LEAST_DOCS = 30
BEST_TERMS = 50
SMOOTH = 5
GROUPS = 16
TERMS = 2048
PIECE = 1 << 20
HELD = 500_000
RESULT = "lang string, source string, part string, item string, value long, rank int"

# Every byte that is no part of a term becomes a space; A-Z become lower case.
FOLD = bytes(b if b >= 128 or chr(b) in string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32
             for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    if len(text) <= PIECE:
        yield text.translate(FOLD).split()
        return
    text, first = text.translate(FOLD), 0
    while first < len(text):
        last = text.find(b" ", first + PIECE)
        last = len(text) if last < 0 else last
        yield text[first:last].split()
        first = last


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of a task's documents, given out whenever ``HELD`` entries are held."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in counts.items():
            n, seen = len(of), docs[lang, source]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                pa.array([t.decode("utf-8") for t in of], pa.string()), pa.array(list(of.values()), pa.int64()),
                pa.array([seen[t] for t in of], pa.int64())], names=["lang", "source", "term", "count", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        lang, source, text = (batch.column(batch.schema.get_field_index(c)) for c in ("lang", "source", "text"))
        texts = strings(text)
        for i in range(len(batch)):
            key = lang[i].as_py() or "", source[i].as_py() or ""
            group = counts.setdefault(key, Counter())
            before, own = len(group), Counter()
            for piece in terms_of(texts[i].as_buffer().to_pybytes()):
                own.update(piece)
            group.update(own)
            docs.setdefault(key, Counter()).update(own.keys())
            held += len(group) - before
            if held >= HELD:
                yield from given()
                held = 0
    yield from given()


def probabilities(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """p of arrays of counts, a thousand at a time: exact up to 10**15 occurrences, where the product would leave 64 bits."""
    b = np.maximum(total + SMOOTH * kept, 1)
    out, rest = np.zeros(np.broadcast(count, b).shape, np.int64), count + SMOOTH
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, b)
        out = out * 1000 + q
    return out + 1


def cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of one cell, and on the diagonal the best terms of each of its groups in this block.

    Rows of kind 0 tell the number of kept terms in the block, of kind 1 name the groups, of kind 2 hold occurrences.
    """
    lang, i, j, _ = (k.as_py() for k in key)
    col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "side", "source_id", "term_id", "count", "total", "kept", "all")}
    of = col["kind"] == 0
    size, kept, all_ = (int(col["count"][of][0]), int(col["kept"][of][0]), int(col["all"][of][0])) if of.any() else (0, 0, 0)
    sides = []
    held = col["kind"] == 2
    ids, at = np.unique(col["term_id"][held], return_inverse=True)
    for side in (0,) if i == j else (0, 1):
        named = (col["kind"] == 1) & (col["side"] == side)
        groups, first = np.unique(col["source_id"][named], return_index=True)
        total = col["total"][named][first]
        mine = col["side"][held] == side
        count = np.zeros((len(groups), len(ids)), np.int64)
        count[np.searchsorted(groups, col["source_id"][held][mine]), at[mine]] = col["count"][held][mine]
        sides.append((groups, count, probabilities(count, total[:, None], kept), probabilities(np.zeros(1, np.int64), total, kept)))
    out: list[list] = [[], [], [], []]
    (a, count, p, p0), (b, _, q, q0) = sides[0], sides[-1]
    for x in range(len(a)):
        apart = np.abs(q - p[x]).sum(1) + (size - len(ids)) * np.abs(q0 - p0[x])
        for mine, others, values in ((np.full(len(b), a[x]), b, apart), *([(b, np.full(len(b), a[x]), apart)] if i != j else [])):
            differ = mine != others
            out[0] += mine[differ].tolist()
            out[1] += others[differ].tolist()
            out[2] += [None] * int(differ.sum())
            out[3] += values[differ].tolist()
    if i == j and len(ids):
        total_count = np.zeros(len(ids), np.int64)
        total_count[at] = col["all"][held]  # of the whole language, on every row of a term
        whole = probabilities(total_count, np.array([all_]), kept)
        for x in range(len(a)):
            f = p[x] - whole
            good = np.flatnonzero((count[x] > 0) & (f > 0))
            good = good[np.lexsort((ids[good], -f[good]))[:BEST_TERMS]]
            out[0] += [int(a[x])] * len(good)
            out[1] += [None] * len(good)
            out[2] += ids[good].tolist()
            out[3] += f[good].tolist()
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), **{
        c: pa.array(v, pa.int64()) for c, v in zip(("source_id", "other_id", "term_id", "value"), out)}})


CELL = "lang string, source_id long, other_id long, term_id long, value long"


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` written in the order given, with ids that ascend in it."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn(name, F.monotonically_increasing_id()), name)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    counts = stored(docs.mapInArrow(counted, "lang string, source string, term string, count long, docs long")
                    .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    # ids ascend with the UTF-8 bytes of terms and sources, so ties are settled by id
    kept = numbered(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all"))
                    .where(F.col("docs") >= least_docs).select("lang", "term", "all"), "term_id", "lang", "term")
    langs = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
                   .withColumn("deep", F.ceil(F.col("kept") / term_block).cast("int")), "langs")
    # every language has as many term blocks as its own terms fill
    dealt = kept.join(langs.select("lang", "deep"), "lang").withColumn("t", F.pmod(F.xxhash64("term_id"), F.col("deep")).cast("int"))
    found = stored(counts.select("lang", "source", "term", "count").join(dealt.drop("deep"), ["lang", "term"])
                   .select("lang", "source", "term_id", "count", "all", "t"), "found")
    groups = (docs.select("lang", "source").distinct()
              .join(found.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
              .withColumn("total", F.coalesce("total", F.lit(0))))
    groups = numbered(groups, "source_id", "lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    wide = math.ceil(most / group_block)

    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = F.lit(None).cast("long")
    part = lambda c: (null if c is None else F.col(c))

    def rows(df: DataFrame, kind: int, source: str | None = None, term: str | None = None, count: str | None = None,
             total: str | None = None, kept: str | None = None, all_: str | None = None) -> DataFrame:
        """Rows of one kind, sent to every cell with their block of groups: left of the diagonal as side 1, else as side 0."""
        out = df.select("lang", "i", "t", F.lit(kind).alias("kind"), part(source).alias("source_id"), part(term).alias("term_id"),
                        part(count).alias("count"), part(total).alias("total"), part(kept).alias("kept"), part(all_).alias("all"))
        out = out.withColumn("other", every(wide))
        side = F.when(F.col("other") < F.col("i"), 1).otherwise(0)
        return out.select("lang", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), "t",
                          side.alias("side"), *[c for c in out.columns if c not in ("lang", "i", "t", "other")])

    sizes = dealt.groupBy("lang", "t").count().join(langs, "lang").withColumn("i", every(wide))
    # a language without terms still has one layer of cells
    depth = F.greatest(F.coalesce("deep", F.lit(1)), F.lit(1))
    names = groups.join(langs.select("lang", "deep"), "lang", "left").withColumn("i", block("source_id", wide)).withColumn(
        "t", F.explode(F.sequence(F.lit(0), depth - 1)))
    # the slices carry a source by its number; their join is on (lang, source)
    slices = found.join(groups.select("lang", "source", "source_id"), ["lang", "source"]).withColumn(
        "i", block("source_id", wide))
    cells = rows(sizes, 0, count="count", kept="kept", all_="lang_total").where("side = 0").union(
        rows(names, 1, source="source_id", total="total")).union(
        rows(slices, 2, source="source_id", term="term_id", count="count", all_="all"))
    partial = stored(cells.groupBy("lang", "i", "j", "t").applyInArrow(cell, CELL), "cells")

    own = groups.select("lang", "source", "source_id")
    pairs = partial.where("other_id is not null").groupBy("lang", "source_id", "other_id").agg(F.sum("value").alias("value"))
    pairs = pairs.join(own.select(F.col("source_id").alias("other_id"), F.col("source").alias("item")), "other_id").select(
        "lang", "source_id", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source_id").orderBy(F.desc("value"), "term_id")
    best = (partial.where("term_id is not null").withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= BEST_TERMS)
            .join(kept.select("term_id", F.col("term").alias("item")), "term_id")
            .select("lang", "source_id", F.lit("term").alias("part"), "item", "value"))
    rank = Window.partitionBy("lang", "source_id", "part").orderBy(F.desc("value"), "item")
    return (pairs.union(best).withColumn("rank", F.row_number().over(rank))
            .join(own.select("source_id", "source"), "source_id").select("lang", "source", "part", "item", "value", "rank"))


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(text, '') AS text FROM documents),
word AS (SELECT r, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
  lambda w: translate(w, '{string.ascii_uppercase}', '{string.ascii_lowercase}'))) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
lang AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM doc) d
  LEFT JOIN kept k ON d.lang = k.lang GROUP BY d.lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT d.lang, d.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM doc) d
  LEFT JOIN cnt c ON d.lang = c.lang AND d.source = c.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
  1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + {SMOOTH})) // (g.n + {SMOOTH} * l.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + {SMOOTH})) // (l.n + {SMOOTH} * l.v) AS q
  FROM grp g JOIN lang l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM part QUALIFY part = 'pair' OR rank <= {BEST_TERMS}"""
