"""Merkle manifest of a document table, built and proved with a slot pivot.

A leaf is the SHA-256 of a row. The leaves of a language ascend by ``doc_id``; every ``FANOUT`` of them are pivoted into the
columns ``h0``, ``h1``, ... of one row by conditional aggregates. All columns concatenated give the parent's digest; without a
child's own column they are its siblings. The roots of the languages, in the order of their names, form one more such tree.

A proof travels downwards once per run of siblings and not once per document: the row of a run is joined with the siblings
of its ancestors and only then unpivoted into its documents. Places of leaves come from a range partitioning by language
and ``doc_id``, with the counts of the partitions added up, so no task orders all documents of a language. Every level
is written to the shared folder; the number of rows falls by ``FANOUT`` from level to level.

Defined cases: a null is ``-`` in a leaf and a language of its own, the first; null ids come first among the leaves; rows of one id
ascend by digest, and equal rows are all kept, each with its own place; a language of one document has its leaf as root;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import stored

FANOUT = 8
SLOTS = range(FANOUT)
# Tables of offsets of up to so many rows (a few dozen bytes each) are broadcast.
OFFSETS = 100_000
RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
LOCAL = (1 << 33) - 1


def digest(*parts: Column | str) -> Column:
    """SHA-256 in hex of all parts behind each other; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """Digest of a row with ``text`` in place of its own."""
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def lower_ascii(text: str) -> Column:
    """Only A-Z in lower case."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with their place ``pos`` in the order of their key (from 0), and ``n``, the number of the key's rows."""
    ordered = stored(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
                     .withColumn("at", F.monotonically_increasing_id())
                     .withColumn("part", F.shiftright("at", 33)), "placed")
    counts = ordered.groupBy(key, "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = F.expr(f"sum(c) over (partition by `{key}` order by part rows between unbounded preceding and 1 preceding)")
    offsets = stored(counts.select(key, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                                   F.expr(f"sum(c) over (partition by `{key}`)").alias("n")), "offsets")
    if offsets.count() <= OFFSETS:
        offsets = F.broadcast(offsets)
    return ordered.join(offsets, [key, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def runs(nodes: DataFrame, **columns: str) -> DataFrame:
    """The slot pivot: one row per run of siblings, with a column per slot for each of ``columns`` (prefix: source)."""
    slot = F.pmod("pos", F.lit(FANOUT))
    return (nodes.groupBy("g", F.expr(f"pos div {FANOUT}").alias("pos"))
            .agg(F.max("n").alias("n"), *[F.max(F.when(slot == s, F.col(name))).alias(f"{prefix}{s}")
                                          for prefix, name in columns.items() for s in SLOTS]))


def parents(run: DataFrame) -> DataFrame:
    return run.select("g", "pos", "n", digest(*[f"h{s}" for s in SLOTS]).alias("h"))


def children(extra: dict[str, str] | None = None) -> Column:
    """Unpivots a run: an array with slot, own digest and the siblings to its left and right."""
    return F.filter(F.array(*[F.struct(
        F.lit(s).alias("slot"), F.col(f"h{s}").alias("h"),
        F.concat_ws("", *[f"h{i}" for i in SLOTS if i < s]).alias("left"),
        F.concat_ws("", *[f"h{i}" for i in SLOTS if i > s]).alias("right"),
        *[F.col(f"{prefix}{s}").alias(name) for prefix, name in (extra or {}).items()]) for s in SLOTS]),
        lambda c: c.h.isNotNull())


def climbed(nodes: DataFrame, most: int, **columns: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, written, and the root of each key with its height (g, height, h).

    ``nodes`` are (g, pos, n, h and what ``columns`` names); ``most`` is the greatest n.
    """
    levels, tops, height = [], nodes.where("n = 1").select("g", F.lit(0).alias("height"), "h"), 0
    while FANOUT ** height < most:
        wide = FANOUT ** height
        levels.append(stored(runs(nodes.where(F.col("n") > wide), h="h", **(columns if not levels else {})), "runs"))
        nodes, height = parents(levels[-1]), height + 1
        tops = tops.union(nodes.where((F.col("n") > wide) & (F.col("n") <= wide * FANOUT))
                          .select("g", F.lit(height).alias("height"), "h"))
    return levels, tops


def beneath(levels: list[DataFrame], starts: DataFrame, last: int) -> DataFrame:
    """Paths of the nodes of level ``last``: (g, pos, path and other columns of ``starts``).

    ``starts`` has a row per key with its height and the path above its root; a path lists the siblings to the left and to the
    right of the node and of its ancestors, from below.
    """
    kept = [c for c in starts.columns if c not in ("g", "height", "path")]
    begin = lambda k: starts.where(F.col("height") == k).select("g", F.lit(0).cast("long").alias("pos"), "path", *kept)
    paths = begin(len(levels))
    for k in range(len(levels) - 1, last - 1, -1):
        step = F.array(F.struct(F.col("child.left").alias("left"), F.col("child.right").alias("right")))
        below = (levels[k].join(paths, ["g", "pos"])
                 .select("g", "pos", "path", *kept, F.explode(children()).alias("child"))
                 .select("g", (F.col("pos") * FANOUT + F.col("child.slot")).alias("pos"),
                         F.concat(step, "path").alias("path"), *kept))
        paths = below.union(begin(k))
    return paths


def folded(own: Column, path: Column) -> Column:
    """The root that a node's digest gives with the siblings of its path."""
    return F.aggregate(path, own, lambda h, step: digest(step.left, h, step.right))


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: leaf, root of its language, root of all, digest of its proof, and the root a tampered copy folds to.

    Tampering lower-cases A-Z in the text of the documents whose crc32(doc_id) is a multiple of 3; ``verified`` tells whether
    the folded root is the root.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang")).alias("g"),
        leaf(F.col("text")).alias("h"), F.when(hit, leaf(lower_ascii("text"))).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"))  # splits runs of equal rows over range partitions
    # written first: the range partitioning samples its input, and the texts are to be read once
    leaves = placed(stored(leaves, "leaves"), "g", "doc_id", "h", "tie").drop("tie").withColumn("tampered", F.coalesce("tampered", "h"))
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    levels, tops = climbed(leaves, most, d="doc_id", t="tampered")
    tops = stored(tops, "subroots")

    # the tree over the languages: one key, leaves in the order of their names
    names = placed(tops.select(F.lit("").alias("all"), F.col("g").alias("lang"), "height", F.col("h").alias("subroot")),
                   "all", "lang").withColumnRenamed("all", "g").withColumn("h", F.col("subroot"))
    names = stored(names, "languages")
    upper, root = climbed(names, names.count())
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    above = beneath(upper, root.select("g", "height", none.alias("path"), F.col("h").alias("root")), 0)
    starts = names.select("pos", F.col("lang").alias("key"), F.col("height").alias("levels"), "subroot").join(above, "pos").select(
        F.col("key").alias("g"), F.col("levels").alias("height"), "path", "subroot", "root")

    out = lambda own, tampered, path, proof: [
        own.alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(tampered, path).alias("folded_root")]
    strings = F.flatten(F.transform("path", lambda s: F.array(s.left, s.right)))
    single = (leaves.where("n = 1").join(starts, "g")
              .select("doc_id", *out(F.col("h"), F.col("tampered"), F.col("path"), digest(strings))))
    if not levels:
        found = single
    else:
        c = F.col("child")
        many = (levels[0].join(beneath(levels, starts, 1), ["g", "pos"])
                .select("path", "subroot", "root", F.concat_ws("", strings).alias("above"),
                        F.explode(children({"d": "doc_id", "t": "tampered"})).alias("child"))
                .select(c.doc_id.alias("doc_id"), *out(
                    c.h, digest(c.left, c.tampered, c.right), F.col("path"), digest(c.left, c.right, "above"))))
        found = many.union(single)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 10) -> str:
    """DuckDB SQL of the same manifest, for up to ``FANOUT ** levels`` documents a language."""
    sql = ["""doc AS (SELECT row_number() OVER () AS r, doc_id, text, source, lang, n_chars,
  coalesce('1' || lang, '0') AS g FROM documents)""", """crc AS (SELECT doc_id, xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM (SELECT DISTINCT doc_id FROM doc WHERE doc_id IS NOT NULL))"""]
    text = lambda t: "sha256(" + " || ".join(
        f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
        for c in ("d.doc_id", "source", "lang", "n_chars", t)) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    sql.append(f"""leaf AS (SELECT r, d.doc_id, g, {text('text')} AS h,
  CASE WHEN crc % 3 = 0 THEN {text(lower)} ELSE {text('text')} END AS t FROM doc d LEFT JOIN crc c ON d.doc_id = c.doc_id)""")
    sql.append("""a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, r) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n FROM leaf)""")

    def tree(a: str) -> None:
        for k in range(levels):
            sql.append(f"""{a}{k + 1} AS (SELECT g, i // {FANOUT} AS i, any_value(n) AS n, sha256(string_agg(h, '' ORDER BY i)) AS h
  FROM {a}{k} WHERE n > {FANOUT ** k} GROUP BY g, i // {FANOUT})""")
        for k in range(levels):
            part = f"PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            sql.append(f"""{a}s{k} AS (SELECT g, i, coalesce(string_agg(h, '') OVER ({part} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({part} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {a}{k} WHERE n > {FANOUT ** k})""")
        sql.append(f"{a}top AS (" + " UNION ALL ".join(
            f"SELECT g, h FROM {a}{k} WHERE n <= {FANOUT ** k} AND n > {FANOUT ** k // FANOUT}" for k in range(levels + 1)) + ")")

    tree("a")
    sql.append("""b0 AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM atop)""")
    tree("b")
    sql.append("""f0 AS (SELECT a0.doc_id, a0.g, a0.i, a0.h AS leaf, a0.t AS o, '' AS proof, atop.h AS subroot, btop.h AS root, b0.i AS j
  FROM a0 JOIN atop ON a0.g = atop.g JOIN b0 ON b0.lang = a0.g CROSS JOIN btop)""")
    last = 0
    for a, i in (("a", "i"), ("b", "j")):
        for k in range(levels):
            match = f"{'s.g = x.g AND ' if a == 'a' else ''}s.i = x.{i} // {FANOUT ** k}"
            sql.append(f"""f{last + 1} AS (SELECT x.* REPLACE (CASE WHEN s.i IS NULL THEN o ELSE sha256(b || o || f) END AS o,
  proof || coalesce(b, '') || coalesce(f, '') AS proof) FROM f{last} x LEFT JOIN {a}s{k} s ON {match})""")
            last += 1
    return "WITH " + ",\n".join(sql) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, o AS folded_root, o = root AS verified FROM f{last}"""
