"""Personal data in whole texts by weak supervision, in DataFrame and SQL functions only.

Patterns wider than the base definitions propose candidate spans. Four labelers vote on each, for (1), against
(-1) or not at all (0): its form (address parts, check digit, number of digits), a gazetteer (top-level domains, card issuers,
country codes), cue words just before it, and what it touches. Expectation-maximisation over the table of vote
patterns estimates each labeler's reliability and every pattern's probability. These are the soft labels of the final span
classifier, a logistic regression on votes, kind and length, which is applied as a Column expression.

Vote patterns and features are counted in Spark; what reaches the driver is a row per combination, 6 kinds * 3 ** 4 votes *
``SIZES`` lengths at most. Base matches are kept whatever the classifier says; it adds further spans that
overlap none of them.

The patterns are possessive and begin where a run begins, so no input makes them backtrack; they match what the plain ones
do. Spans are in code points, end exclusive. Defined cases: a null text is empty; rows equal in id and
text each get the same spans; an empty table gives no rows; other columns are ignored (kept by ``masked``).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import fresh, stored, without

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
VOTES = ("v_form", "v_gazetteer", "v_cue", "v_edge")
SIZES = 8
ACCEPT = 0.5
CUE_REACH = 40
BROADCAST_BYTES = 32 << 20

# The base patterns, written without backtracking, and wider ones.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
HIDDEN_EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
                r"(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++")
HOME_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])"
# pattern, kind, whether it has base matches, what a text must hold for it
PATTERNS = (
    (EMAIL, 0, True, "@"), (IP, 1, True, "."), (CARD, 2, True, None), (PHONE, 3, True, "+"),
    (HIDDEN_EMAIL, 0, False, "at"), (HOME_PHONE, 3, False, None), (SSN, 4, False, "-"), (IBAN, 5, False, None),
)
# Gazetteers and cue words.
DOMAINS = ("com org net edu gov mil int info biz io co dev app ai me tv de fr es it nl be ch at uk us ca au nz jp cn in "
           "br mx pt pl se no fi dk ie cz gr ru tr za kr eu example test").split()
COUNTRY_CODES = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                 "81 82 84 86 90 91 92 93 94 95 98").split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6)"
CUES = {
    0: "mail|contact|write|courriel|correo|kontakt", 1: r"\bip\b|host|server|address|adresse|login|client",
    2: "card|visa|master|credit|carte|karte|tarjeta|payment", 3: "call|phone|tel|mobile|fax|appel|ruf|llam",
    4: "ssn|social|security", 5: "iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"version|\bv\.?\s*$|isbn|order|invoice|build|serial|part no|section|chapter"


def _spans_of(text: Column, pattern: str, kind: int, base: bool, needs: str | None) -> Column:
    """All matches of one pattern as structures with begin, what stands before and the sign after."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    row = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    nothing = F.expr("cast(array() as array<struct<kind:int,base:boolean,hit:string,before:string,after:string,"
                     "begin:int>>)")

    def add(have: Column, x: Column) -> Column:
        begin = have["at"] + F.length(x["gap"])
        found = F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["hit"].alias("hit"),
                         F.right(x["gap"], F.lit(CUE_REACH)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"),
                         begin.alias("begin"))
        return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(have["out"], F.array(found)).alias("out"))

    every = F.aggregate(F.filter(row, lambda x: x["hit"].isNotNull()),
                        F.struct(F.lit(0).alias("at"), nothing.alias("out")), add, lambda have: have["out"])
    possible = F.contains(text, F.lit(needs)) if needs else F.rlike(text, F.lit("[0-9]"))
    return F.when(possible, every).otherwise(nothing)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate: doc_id, h (hash of the text), kind, base, begin, end, the votes and a length class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"),
                       F.explode(F.concat(*[_spans_of(text, *p) for p in PATTERNS])).alias("x")).select(
        "doc_id", "h", "x.*")
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n_digits = F.length("digits")
    parts = F.split("hit", r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                     & (F.coalesce(F.try_to_number(F.right(p, F.lit(4)), F.lit("9999")), F.lit(999)) <= 255))
    card = F.when(n_digits.between(13, 19), _luhn(F.col("digits"))).otherwise(False)
    good = (F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, small)
            .when(F.col("kind") == 2, card).when(F.col("kind") == 3, n_digits.between(9, 15))
            .otherwise(False))
    rows = rows.withColumn("digits", digits).withColumn("good", good)
    # digit strings of other lengths are no card candidates, nor are numbers with few digits phones
    rows = rows.where((F.col("kind") != 2) | n_digits.between(13, 19)).where(
        (F.col("kind") != 3) | n_digits.between(7, 17))
    domain = F.lower(F.regexp_extract("hit", r"([A-Za-z0-9-]+)$", 1))
    known = (F.when(F.col("kind") == 0, domain.isin(DOMAINS))
             .when(F.col("kind") == 1, ~F.rlike("hit", F.lit(r"^0+\.|\.0+\.0+\.0+$")))
             .when(F.col("kind") == 2, F.rlike("digits", F.lit(ISSUERS)))
             .when((F.col("kind") == 3) & F.col("base"), functools.reduce(
                 lambda a, b: a | b, [F.substring("digits", 1, k).isin([c for c in COUNTRY_CODES if len(c) == k])
                                      for k in (1, 2)])))
    cue = functools.reduce(lambda a, kv: a.when(F.col("kind") == kv[0], F.rlike(F.lower("before"), F.lit(kv[1]))),
                           list(CUES.items())[1:], F.when(F.col("kind") == 0, F.rlike(F.lower("before"), F.lit(CUES[0]))))
    against = F.rlike(F.lower("before"), F.lit(AGAINST))
    touches = F.rlike("before", F.lit(r"[\p{L}0-9_]$")) | F.rlike(F.coalesce("after", F.lit("")), F.lit(r"^[\p{L}0-9_]"))
    vote = lambda yes: F.when(yes, 1).when(~yes, -1).otherwise(0)
    return rows.select(
        "doc_id", "h", "kind", (F.col("base") & F.col("good")).alias("base"), "begin",
        (F.col("begin") + F.length("hit")).alias("end"),
        F.when(F.col("base"), vote(F.col("good"))).otherwise(0).alias("v_form"), vote(known).alias("v_gazetteer"),
        F.when(against, -1).when(cue, 1).otherwise(0).alias("v_cue"),
        F.when(touches, -1).otherwise(1).alias("v_edge"),
        F.least(F.floor(F.log2(F.length("hit").cast("double"))), F.lit(SIZES - 1)).cast("int").alias("size"))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes) -> count: the share of true candidates, and per labeler how often it is right on each class.

    Labelers start out better than chance; a few pseudo-counts keep rare ones from extremes.
    """
    prior, right = 0.5, [(0.8, 0.8)] * len(VOTES)
    for _ in range(rounds):
        weight = {v: posterior(v, prior, right) for v in patterns}
        total = sum(patterns.values())
        prior = min(0.99, max(0.01, (1 + sum(weight[v] * n for v, n in patterns.items())) / (2 + total)))
        new = []
        for i in range(len(VOTES)):
            hit = [8.0, 8.0]
            seen = [10.0, 10.0]
            for v, n in patterns.items():
                if v[i]:
                    w = weight[v]
                    seen[0] += w * n
                    seen[1] += (1 - w) * n
                    hit[0] += w * n * (v[i] > 0)
                    hit[1] += (1 - w) * n * (v[i] < 0)
            new.append((min(0.99, max(0.5, hit[0] / seen[0])), min(0.99, max(0.5, hit[1] / seen[1]))))
        right = new
    return prior, right


def posterior(votes: tuple[int, ...], prior: float, right: list[tuple[float, float]]) -> float:
    """The probability that a candidate with these votes is personal data."""
    yes, no = prior, 1 - prior
    for v, (sensitive, specific) in zip(votes, right):
        if v:
            yes *= sensitive if v > 0 else 1 - sensitive
            no *= 1 - specific if v > 0 else specific
    return yes / (yes + no)


def _features(kind: int, size: int, votes: tuple[int, ...]) -> list[str]:
    return ["one", f"kind={kind}", f"size={size}", *(f"{name}={v}" for name, v in zip(VOTES, votes) if v)]


def classifier(rows: list[tuple[int, int, tuple[int, ...], int, float]], rounds: int = 400) -> dict[str, float]:
    """Logistic regression on (kind, size, votes, count, soft label), by full-batch gradient steps."""
    weights: dict[str, float] = {}
    total = sum(n for *_, n, _ in rows) or 1
    every = [(_features(k, s, v), n / total, y) for k, s, v, n, y in rows]
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, n, y in every:
            error = n * (_sigmoid(sum(weights.get(f, 0.0) for f in names)) - y)
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - 2.0 * (g + 1e-4 * weights.get(f, 0.0))
    return weights


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from the candidates' votes."""
    counted = found.groupBy("kind", "size", *VOTES).count().collect()
    rows = sorted((r.kind, r.size, tuple(r[v] for v in VOTES), r["count"]) for r in counted)
    patterns: dict[tuple[int, ...], int] = {}
    for _, _, votes, n in rows:
        patterns[votes] = patterns.get(votes, 0) + n
    prior, right = reliabilities(patterns)
    return classifier([(k, s, v, n, posterior(v, prior, right)) for k, s, v, n in rows])


def probability(weights: dict[str, float]) -> Column:
    """The classifier as a Column over kind, size and votes."""
    total = F.lit(weights.get("one", 0.0))
    for name, weight in weights.items():
        if name != "one":
            column, value = name.split("=")
            total = total + F.when(F.col(column) == int(value), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _overlapping(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (doc_id, h) with a span: ``base`` and ``every``, arrays of (kind, begin, end) in order."""
    found = stored(candidates(docs, id_col, text_col), "candidates")
    kept = (found.withColumn("p", probability(fit(found))).where(F.col("base") | (F.col("p") >= ACCEPT))
            .select("doc_id", "h", "base", F.struct("kind", "begin", "end").alias("s")).distinct())
    arrays = kept.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), F.col("s")))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), F.col("s")))).alias("more"))
    # both are attributes of an aggregate, so the inner loop does not evaluate them again
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: _overlapping(m, b)))
    return arrays.select("doc_id", "h", "base", F.sort_array(F.concat("base", free)).alias("every"))


def _shown(array: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"),
                                s["end"].cast("string"))
    return F.concat_ws(",", F.transform(array, one))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts and digest of base spans, and all spans as text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    none = F.expr("cast(array() as array<struct<kind:int,begin:int,end:int>>)")
    found = spans(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "base", "every")
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.id) & (rows.h == found.hash), "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("every", none).alias("every"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return joined.select("doc_id", *counts, F.sha2(_shown("base"), 256).alias("base_sha256"),
                         _shown("every").alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are one.

    ``length_col``, where there is such a column, follows the text.
    """
    key = fresh(docs, "hash")
    ident, h, every = (fresh(docs, c) for c in ("id", "h", "every"))
    found = stored(spans(docs, id_col, text_col).select(
        F.col("doc_id").alias(ident), F.col("h").alias(h), F.col("every").alias(every)), "spans")
    size = found.agg(F.sum(48 + 32 * F.size(every))).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    text = F.col(text_col)
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = rows.join(found, rows[id_col].eqNullSafe(found[ident]) & (rows[key] == found[h]), "left")
    by_place = F.sort_array(F.transform(every, lambda s: F.struct(s["begin"].alias("b"), s["end"].alias("e"),
                                                                  s["kind"].alias("k"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def add(have: Column, s: Column) -> Column:
        plain = F.substring(text, have["at"] + 1, s["b"] - have["at"])
        apart = s["b"] >= have["at"]
        return F.struct(
            F.greatest(have["at"], s["e"]).alias("at"),
            F.when(apart, F.concat(have["out"], plain, F.element_at(names, s["k"] + 1))).otherwise(have["out"])
            .alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate(by_place, start, add,
                      lambda have: F.concat(have["out"], F.substring(text, have["at"] + 1, F.length(text))))
    joined = joined.withColumn(text_col, F.when(F.col(every).isNotNull(), new).otherwise(text))
    if length_col in docs.columns:
        changed = F.when(F.col(every).isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType))
        joined = joined.withColumn(length_col, F.coalesce(changed, F.col(length_col)))
    return without(joined, key, ident, h, every)
