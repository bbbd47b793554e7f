"""Toxicity of whole texts: a lexicon with spelling tolerance, and the words around each find.

Terms are learned from labelled texts: words that turn up in many different contexts (word before, word after) of toxic
texts and hardly any of clean ones. Contexts, not documents, are counted, so copies of one toxic text do not make
its ordinary words terms. The terms form a trie; its intersection with the Levenshtein automaton (no edit for
short terms, one from ``ONE_EDIT`` letters, two from ``TWO_EDITS``) is made deterministic, and all words of a batch walk
through its transition table in step.

Each find is exact or misspelled, and plain, quoted (a quotation mark or a word of reporting within ``WINDOW`` words) or
addressed (a word of address within it). Logistic regression on these counts gives the score. Misspellings that clean
texts of the sample hold too are ordinary words and no finds.

Fitting uses a bounded sample: up to ``TOXIC`` and ``CLEAN`` distinct labelled texts by hash, whole. Defined cases: null and
empty texts have no finds and the score of such; without labels of both kinds every score is 0; repeated rows
each have a result; conflicting labels of one document both count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import BASE, Hasher, blocks, codepoints, mixed, raw, sample_below, stored, strings
from tidewake.llm.language import letter_table

TOXIC, CLEAN = 4000, 8000
TERMS = 300
CONTEXTS = 3  # different contexts in toxic texts that a term needs at least
RATIO = 12.0  # how much more common it is there
ONE_EDIT, TWO_EDITS = 5, 10
WINDOW = 6
BLOCK = 1 << 20

# Quotation marks, words of reporting and of address in English, French, German and Spanish.
QUOTES = "\"“”„«»‹›"
REPORTING = ("said says called calls word words term quote quoted insult slur dit disait mot mots terme insulte "
             "sagte sagt wort wörter begriff beleidigung dijo dice palabra palabras término insulto").split()
ADDRESS = ("you your yours u ur tu te toi vous votre du dich dir dein deine ihr euch tú usted ustedes eres "
           "vosotros").split()


def labelled(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id",
             text_col: str = "text", label: str = "toxic") -> DataFrame:
    """A bounded sample of distinct (text, toxic) of rows that ``may_learn`` (on the labels' id)."""
    marks = (labels.where(may_learn & F.col(label).isin(0, 1))
             .select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("toxic")))
    count = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for value, most in ((1, TOXIC), (0, CLEAN)):
        keep = keep | ((F.col("toxic") == value) & sample_below("pick", 2 * most / max(1, count.get(value, 1))))
    marks = marks.withColumn("pick", F.xxhash64("id")).where(keep).select("id", "toxic")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most 2 * (TOXIC + CLEAN) labels, whatever the input.
    found = stored(texts.join(F.broadcast(marks), "id").where("text is not null")
                   .groupBy("toxic", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")), "labelled")
    # Only label and hash are put in order; the texts stay where they are, spread by hash.
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy("h"))
    picked = found.select("toxic", "h").withColumn("place", rank).where(
        F.col("place") <= F.when(F.col("toxic") == 1, TOXIC).otherwise(CLEAN)).select("toxic", "h")
    return found.join(F.broadcast(picked), ["toxic", "h"], "left_semi").select("text", "toxic")


_LETTERS: list[np.ndarray] = []


def words(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters (0 for others), and begin, end and text of every run of letters."""
    if not _LETTERS:
        _LETTERS.append(letter_table())
    low = _LETTERS[0][points]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    cut = np.zeros(len(low) + 1, bool)
    cut[at] = True
    change = inside[1:] != inside[:-1]
    begin = np.flatnonzero(inside[1:-1] & (change[:-1] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (change[1:] | cut[1:])) + 1
    return low, begin, end, np.searchsorted(at, begin, side="right") - 1


def spelled(low: np.ndarray, begin: int, end: int) -> str:
    return low[begin:end].astype("<u4").tobytes().decode("utf-32-le")


def _context_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct (word, context) of a block of texts, with the label."""
    for part in blocks(batches, "text", BLOCK):
        low, begin, end, owner = words(*codepoints(*raw(strings(part.column("text")))))
        if not len(begin):
            continue
        h = Hasher(mixed(low.astype(np.uint64) + BASE)).spans(begin, end)
        side = np.zeros((2, len(h)), np.uint64)
        same = owner[1:] == owner[:-1]
        side[0, 1:][same] = h[:-1][same]
        side[1, :-1][same] = h[1:][same]
        toxic = part.column("toxic").to_numpy()[owner]
        context = mixed(side[0] * BASE + side[1])
        first = np.unique(mixed(h + context * BASE) * np.uint64(2) + toxic.astype(np.uint64), return_index=True)[1]
        first = first[end[first] - begin[first] <= 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([spelled(low, begin[i], end[i]) for i in first], pa.string()), pa.array(toxic[first]),
             pa.array(context[first].view(np.int64))], names=["word", "toxic", "context"])


def learned_terms(sample: DataFrame, terms: int = TERMS) -> list[str]:
    """The words that mark toxic texts best; at most ``terms``, of which one at most is expected by chance."""
    seen = sample.mapInArrow(_context_task, "word string, toxic int, context long").distinct()
    count = stored(seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "words")
    whole = count.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    frequent = count.where(F.col("t") + F.col("c") >= CONTEXTS)
    if not whole.t or not whole.c:
        return []
    share = whole.t / (whole.t + whole.c)
    rate = F.col("t") / (F.col("t") + F.col("c"))
    # Chernoff: a word of this rate comes by chance with a probability below exp(-surprise)
    surprise = F.col("t") * F.log(rate / share) + F.when(
        F.col("c") > 0, F.col("c") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    ratio = ((F.col("t") + 0.5) / whole.t) / ((F.col("c") + 0.5) / whole.c)
    best = (frequent.where(F.col("t") >= CONTEXTS).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
            .withColumn("surprise", surprise).where(F.col("surprise") > math.log(max(2, frequent.count())))
            .orderBy(F.desc("surprise"), "word").limit(terms))
    return [r.word for r in best.collect()]


def edits(term: str) -> int:
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


@dataclass
class Speller:
    """The lexicon's trie crossed with Levenshtein automata, as one transition table.

    ``accept`` has, per state, 0 for a term, 1 for a misspelling of one, -1 for neither; state 0 is dead.
    """

    classes: dict[int, int]  # letters of the lexicon; others are class 0
    table: np.ndarray
    accept: np.ndarray


def speller(terms: list[str]) -> Speller:
    """Subset construction over (trie node, edits so far)."""
    children: list[dict[str, int]] = [{}]
    allowed = [-1]  # edits of the term that ends here
    room = [0]  # the most edits of any term through here
    for term in terms:
        node = 0
        room[0] = max(room[0], edits(term))
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                allowed.append(-1)
                room.append(0)
            node = children[node][c]
            room[node] = max(room[node], edits(term))
        allowed[node] = edits(term)
    letters = sorted({c for t in terms for c in t})

    def settled(best: dict[int, int]) -> frozenset[tuple[int, int]]:
        todo = list(best)
        while todo:  # a letter of the term left out
            node = todo.pop()
            for child in children[node].values():
                e = best[node] + 1
                if e <= room[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        return frozenset(best.items())

    def step(state: frozenset[tuple[int, int]], letter: str | None) -> frozenset[tuple[int, int]]:
        best: dict[int, int] = {}
        for node, e in state:
            if e + 1 <= room[node]:  # a letter too many
                best[node] = min(best.get(node, 99), e + 1)
            for c, child in children[node].items():  # the letter, or another in its place
                cost = e + (c != letter)
                if cost <= room[child]:
                    best[child] = min(best.get(child, 99), cost)
        return settled(best)

    start = settled({0: 0})
    number: dict[frozenset, int] = {frozenset(): 0, start: 1}
    todo, rows = [start], {0: [0] * (len(letters) + 1)}
    while todo:
        state = todo.pop()
        row = []
        for letter in (None, *letters):
            after = step(state, letter)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows[number[state]] = row
    accept = np.full(len(number), -1, np.int8)
    for state, i in number.items():
        ends = [e for node, e in state if 0 <= e <= allowed[node]]
        if ends:
            accept[i] = min(1, min(ends))
    table = np.array([rows[i] for i in range(len(number))], np.int32)
    return Speller({ord(c): i + 1 for i, c in enumerate(letters)}, table, accept)


class Finder:
    """Finds of a batch of texts."""

    def __init__(self, machine: Speller, ordinary: frozenset[str]):
        self.machine, self.ordinary = machine, ordinary
        self.kind = np.zeros(0x110000, np.int32)
        for point, i in machine.classes.items():
            self.kind[point] = i
        cue = {}
        for names, mark in ((REPORTING, 1), (ADDRESS, 2)):
            for name in names:
                points = np.array([ord(c) for c in name], np.uint64)
                key = Hasher(mixed(points + BASE)).spans(np.array([0]), np.array([len(points)]))[0]
                cue[int(key)] = mark
        self.cue_keys = np.array(sorted(cue), np.uint64)
        self.cue_marks = np.array([cue[k] for k in sorted(cue)], np.int8)
        self.quote = np.zeros(0x110000, bool)
        self.quote[[ord(c) for c in QUOTES]] = True

    def matches(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that the automaton accepts, and 0 or 1 for exact or misspelled."""
        kinds = self.kind[low]
        alive = np.arange(len(begin))
        state = np.ones(len(begin), np.int32)
        at = begin.copy()
        found, how = [], []
        while len(alive):
            state = self.machine.table[state, kinds[at]]
            at = at + 1
            over = at == end[alive]
            verdict = self.machine.accept[state]
            hit = over & (verdict >= 0)
            found.append(alive[hit])
            how.append(verdict[hit])
            go = ~over & (state != 0)
            alive, state, at = alive[go], state[go], at[go]
        found, how = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, how))
        order = np.argsort(found, kind="stable")
        return found[order], how[order]

    def features(self, points: np.ndarray, at: np.ndarray, collect: set[str] | None = None) -> np.ndarray:
        """Per text: exact and misspelled finds that are plain, quoted, addressed; finds per word."""
        n = len(at) - 1
        low, begin, end, owner = words(points, at)
        out = np.zeros((n, 6))
        hits, how = self.matches(low, begin, end)
        if len(hits):
            h = Hasher(mixed(low.astype(np.uint64) + BASE)).spans(begin, end)
            place = np.searchsorted(self.cue_keys, h)
            place[place == len(self.cue_keys)] = 0
            mark = np.where(self.cue_keys[place] == h, self.cue_marks[place], 0)
            quotes = np.concatenate([[0], np.cumsum(self.quote[points])])
            first = np.searchsorted(owner, owner[hits])
            last = np.searchsorted(owner, owner[hits], side="right")
            for hit, fuzzy, lo, hi in zip(hits, how, np.maximum(first, hits - WINDOW),
                                          np.minimum(last, hits + WINDOW + 1)):
                if fuzzy:
                    word = spelled(low, begin[hit], end[hit])
                    if collect is not None:
                        collect.add(word)
                    if word in self.ordinary:
                        continue
                around = mark[lo:hi]
                # quotation marks just outside the outermost words count too
                text_at, text_end = at[owner[hit]], at[owner[hit] + 1]
                quoted = quotes[min(end[hi - 1] + 1, text_end)] - quotes[max(begin[lo] - 1, text_at)] > 0
                case = 1 if quoted or (around == 1).any() else 2 if (around == 2).any() else 0
                out[owner[hit], case + 3 * int(fuzzy)] += 1
        size = np.bincount(owner, minlength=n)
        per_word = out.sum(axis=1) / np.maximum(size, 20)
        return np.column_stack([np.log1p(out), 10 * per_word, (out.sum(axis=1) > 0)])


def _feature_task(machine: Speller, ordinary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(machine, ordinary)
        for part in blocks(batches, "text", BLOCK):
            points, at = codepoints(*raw(strings(part.column("text"))))
            toxic = part.column("toxic").to_numpy()
            if not ordinary:  # first run: misspellings that clean texts hold
                seen: set[str] = set()
                for i in np.flatnonzero(toxic == 0):
                    finder.features(points[at[i]:at[i + 1]], np.array([0, at[i + 1] - at[i]]), seen)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string()), pa.nulls(len(seen), pa.binary()),
                                                  pa.nulls(len(seen), pa.int32())], names=["word", "x", "toxic"])
            x = finder.features(points, at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(x), pa.string()), pa.array([row.tobytes() for row in x], pa.binary()),
                 pa.array(toxic)], names=["word", "x", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights, the constant last, by Newton's method; the constant is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    machine: Speller
    ordinary: frozenset[str]
    weights: np.ndarray


def fit(sample: DataFrame) -> Model | None:
    """Lexicon, automaton, ordinary words and weights from (text, toxic)."""
    sample = stored(sample, "labelled")
    terms = learned_terms(sample)
    kinds = sample.select("toxic").distinct().count()
    if kinds < 2:
        return None
    machine = speller(terms)
    schema = "word string, x binary, toxic int"
    clean = (sample.mapInArrow(_feature_task(machine, frozenset()), schema)
             .where("word is not null").select("word").distinct().collect())
    ordinary = frozenset(r.word for r in clean) | {""}
    rows = sample.mapInArrow(_feature_task(machine, ordinary), schema).where("x is not null").collect()
    x = np.array([np.frombuffer(r.x) for r in rows])
    y = np.array([r.toxic for r in rows], float)
    order = np.lexsort((*x.T, y))  # the same weights however the rows arrive
    return Model(machine, ordinary, logistic(x[order], y[order]))


SCORED_DDL = "doc_id long, score double, predicted int"


def _score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.machine, model.ordinary)
        for part in blocks(batches, "text", BLOCK):
            x = finder.features(*codepoints(*raw(strings(part.column("text")))))
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return run


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return rows.mapInArrow(_score_task(model), SCORED_DDL)
