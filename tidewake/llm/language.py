"""Language of whole texts by string kernels.

The kernel of two texts is the number of n-grams (all orders up to ``ORDERS``, presence only) they share,
divided by the root of the product of how many each has: the normalised blended-spectrum presence kernel.
Characters are lower-cased letters; whatever is no letter is one boundary sign however long; letters
that the training sample does not hold often are one further sign.

Fitting takes a bounded sample of labelled texts, ``PER_LANGUAGE`` distinct ones per label by hash, whole, of up to
``TRAIN_CHARS`` code points each. ``LANDMARKS`` of them, taken evenly from the labels, span the Nystroem approximation; kernel ridge
regression with one machine per label (1 for it, -1 for the rest) gives the weights. Kernels are linear in the
presence vector, so the product of landmark matrix and weights is taken once, and a batch of texts is scored by
one product: presence matrix times that.

Ridge outputs are near 0 for a text that shares nothing with the landmarks, so the score cannot reject a strange language.
That is left to the share of a text's distinct n-grams of full order that the landmarks have. Its limit per label comes
from the labelled sample, in two folds: from the usual share of texts whose own label is left out, ``RISE`` of the way to the
least share of held-out texts of the label (``CLEAN`` quantile), so that a label's texts on other matters stay. Texts of few
n-grams get ``SLACK`` standard deviations.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without labelled texts all are; ties go to the
label first in order; a label with fewer than ``LEAST_TEXTS`` texts has no limit, one label alone has that of its own texts;
repeated rows each have a result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import blocks, codepoints, raw, sample_below, strings

ORDERS = 3
ALPHABET = 125  # letters with a sign of their own
PER_LANGUAGE = 250
TRAIN_CHARS = 20_000
LANDMARKS = 200
RIDGE = 0.05
CLEAN, RISE, SLACK, LEAST_TEXTS = 0.01, 1 / 3, 2.0, 10
UNKNOWN = "und"
BLOCK = 1 << 20
SIGNS = ALPHABET + 2  # boundary 0, the letters, and the rest
ROWS = 256  # texts per matrix product


def training_sample(docs: DataFrame, label: str, may_learn: Column, per_label: int = PER_LANGUAGE,
                    longest: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """Up to ``per_label`` distinct (text, label) for each label, by hash of the text.

    Copies of a text are one before they are gathered; the fraction follows from how many distinct texts of
    allowed length a label has.
    """
    own = docs.where(may_learn & F.col(label).isNotNull()).select("text", F.col(label).alias("label"))
    hashed = own.where(F.col("text").isNotNull() & (F.length("text") <= longest)).withColumn("h", F.xxhash64("text"))
    counts = {r.label: r["count"] for r in hashed.select("label", "h").distinct().groupBy("label").count().collect()}
    picked = F.lit(False)
    for value, n in counts.items():
        picked = picked | ((F.col("label") == value) & sample_below("h", 3 * per_label / n))
    rows = (hashed.where(picked).groupBy("label", "h").agg(F.min("text").alias("text")).collect())
    taken: Counter[str] = Counter()
    out = []
    for r in sorted(rows, key=lambda r: (r.label, r.h)):
        if taken[r.label] < per_label:
            taken[r.label] += 1
            out.append((r.text, r.label))
    return out


def letter_table() -> np.ndarray:
    """Per code point the lower-case letter's code point, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


_TABLES: dict[tuple[int, ...], np.ndarray] = {}


def sign_table(alphabet: tuple[int, ...]) -> np.ndarray:
    """Per code point its sign."""
    if alphabet not in _TABLES:
        letters = letter_table()
        own = np.full(0x110000, SIGNS - 1, np.int32)
        own[0] = 0
        own[list(alphabet)] = np.arange(1, len(alphabet) + 1)
        _TABLES[alphabet] = own[letters]
    return _TABLES[alphabet]


class Grams:
    """Distinct n-grams of texts; numbers below ``SIGNS ** (ORDERS + 1)``, in one table for all orders."""

    def __init__(self, alphabet: tuple[int, ...]):
        self.signs = sign_table(alphabet)
        self.seen = np.zeros(sum(SIGNS ** n for n in range(1, ORDERS + 1)), np.int32)

    def of(self, points: np.ndarray) -> tuple[np.ndarray, bool]:
        """The n-grams of a text that hold a letter, each once, and whether it has a letter."""
        signs = self.signs[points]
        keep = np.ones(len(signs), bool)
        keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
        signs = np.concatenate([[0], signs[keep], [0]]) if len(signs) else np.zeros(1, np.int32)
        if not signs.any():
            return np.zeros(0, np.int64), False
        every, code, offset = [], signs.astype(np.int64), 0
        for order in range(1, ORDERS + 1):
            if order > 1:
                if len(signs) < order:
                    break
                code = code[:-1] * SIGNS + signs[order - 1:]
            every.append(code + offset)
            offset += SIGNS ** order
        grams = np.concatenate(every)
        place = np.arange(len(grams), dtype=np.int32)
        self.seen[grams] = place  # the last of equal ones stays
        return grams[self.seen[grams] == place], True


@dataclass
class Model:
    labels: list[str]
    alphabet: tuple[int, ...]
    vocabulary: np.ndarray  # n-grams of the landmarks
    weights: np.ndarray  # vocabulary x labels: landmark presence, norms and ridge weights multiplied
    least: np.ndarray  # per label the least share of known n-grams of full order


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The classifier of a sample of (text, label); None without a text that has a letter."""
    letters = Counter(c for text, _ in sample for c in text.lower() if c.isalpha())
    alphabet = tuple(sorted(ord(c) for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]
                            if len(c) == 1))
    grams = Grams(alphabet)
    points = [np.frombuffer(text.encode("utf-32-le"), np.uint32) for text, _ in sample]
    found = [(grams.of(p)[0], label) for p, (_, label) in zip(points, sample)]
    found = [(g, label) for g, label in found if len(g)]
    if not found:
        return None
    labels = sorted({label for _, label in found})
    share = math.ceil(landmarks / len(labels))
    marks = [g for label in labels for g in [g for g, own in found if own == label][:share]]
    vocabulary = np.unique(np.concatenate(marks))
    presence = lambda some: _presence(some, vocabulary)
    mark = presence(marks) / np.sqrt([len(g) for g in marks])[:, None]
    every = presence([g for g, _ in found]) / np.sqrt([len(g) for g, _ in found])[:, None]
    values, vectors = np.linalg.eigh(mark @ mark.T)
    sound = values > values.max() * 1e-8
    root = vectors[:, sound] / np.sqrt(values[sound])  # Nystroem: kernel with landmarks times this
    z = every @ mark.T @ root
    target = np.array([[1.0 if own == label else -1.0 for label in labels] for _, own in found])
    beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ target)
    return Model(labels, alphabet, vocabulary, (mark.T @ (root @ beta)).astype(np.float32),
                 _least_shares(found, labels, share))


def whole(grams: np.ndarray) -> np.ndarray:
    """The n-grams of full order."""
    return grams[grams >= sum(SIGNS ** n for n in range(1, ORDERS))]


def telling(grams: np.ndarray) -> np.ndarray:
    """Those of full order without the sign that all rare letters share, which tells nothing of them."""
    grams = whole(grams)
    code = grams - sum(SIGNS ** n for n in range(1, ORDERS))
    rest = np.zeros(len(grams), bool)
    for n in range(ORDERS):
        rest |= code // SIGNS ** n % SIGNS == SIGNS - 1
    return grams[~rest]


def _least_shares(found: list[tuple[np.ndarray, str]], labels: list[str], share: int) -> np.ndarray:
    """Per label the limit between its own texts and those of a language that was not learned."""
    of = {label: [whole(g) for g, own in found if own == label] for label in labels}
    own: dict[str, list[float]] = {label: [] for label in labels}
    strange = []
    for fold in (0, 1):
        marks = {label: [telling(g) for g in of[label][fold::2][:share]] for label in labels}
        known = {label: np.unique(np.concatenate([np.zeros(0, np.int64), *m])) for label, m in marks.items()}
        every = np.unique(np.concatenate(list(known.values())))
        for label in labels:
            others = np.unique(np.concatenate([np.zeros(0, np.int64), *(v for k, v in known.items() if k != label)]))
            for g in of[label][1 - fold::2]:
                if len(g):
                    own[label].append(float(np.isin(g, every).mean()))
                    if len(labels) > 1:
                        strange.append(float(np.isin(g, others).mean()))
    usual = float(np.median(strange)) if strange else None
    out = np.zeros(len(labels))
    for i, label in enumerate(labels):
        if len(own[label]) >= LEAST_TEXTS:
            clean = float(np.quantile(own[label], CLEAN))
            out[i] = clean if usual is None else min(clean, usual + RISE * (clean - usual))
    return out


def _presence(some: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(some), len(vocabulary)), np.float32)
    for row, grams in zip(out, some):
        at = np.searchsorted(vocabulary, grams)
        at[at == len(vocabulary)] = 0
        row[at[vocabulary[at] == grams]] = 1
    return out


PREDICTED_DDL = "doc_id long, lang_pred string, score double"


class Predictor:
    """A model with the tables a task needs, built once per task."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = Grams(model.alphabet)
        self.place = np.full(len(self.grams.seen), -1, np.int32)
        self.place[model.vocabulary] = np.arange(len(model.vocabulary))
        self.familiar = np.zeros(len(self.grams.seen), bool)
        self.familiar[telling(model.vocabulary)] = True
        self.presence = np.zeros((ROWS, len(model.vocabulary)), np.float32)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The label and score of every text, and whether enough of its n-grams are known for that label."""
        points, at = codepoints(*raw(texts))
        n = len(at) - 1
        scores, has_letter = np.full((n, len(self.model.labels)), -1.0), np.zeros(n, bool)
        full, shared = np.zeros(n), np.zeros(n)
        for first in range(0, n, ROWS):
            rows = range(first, min(first + ROWS, n))
            norm = np.ones(len(rows))
            self.presence[:len(rows)] = 0
            for i in rows:
                own, has_letter[i] = self.grams.of(points[at[i]:at[i + 1]])
                norm[i - first] = math.sqrt(max(1, len(own)))
                ends = whole(own)
                full[i], shared[i] = len(ends), np.count_nonzero(self.familiar[ends])
                known = self.place[own]
                self.presence[i - first, known[known >= 0]] = 1
            scores[rows] = self.presence[:len(rows)] @ self.model.weights / norm[:, None]
        best = scores.argmax(axis=1)
        score = np.where(has_letter, np.clip((1 + scores.max(axis=1)) / 2, 0, 1), 0.0)
        least = self.model.least[best]
        fits = has_letter & (shared >= least * full - SLACK * np.sqrt(full * least * (1 - least)))
        return [self.model.labels[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)], score, fits


def _predict_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model)
        for part in blocks(batches, "text", BLOCK):
            names, score, _ = predict(strings(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict_task(model), PREDICTED_DDL)


def in_a_language(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all their columns, whose text fits its language and has a score of ``least`` or more.

    Without a model, as no row had a label to learn from, every text with a letter stays.
    """
    if model is None:
        return docs.where(F.rlike(F.col(text_col), F.lit(r"\p{L}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model)
        for part in blocks(batches, text_col, BLOCK):
            _, score, fits = predict(strings(part.column(text_col)))
            yield part.filter(pa.array(fits & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def learned(docs: DataFrame, id_col: str = "doc_id", label: str = "lang") -> Model | None:
    """The classifier of all rows outside the fold held out (remainder 2 of 4)."""
    return fit(training_sample(docs, label, F.coalesce(remainder(id_col, 4) != 2, F.lit(True))))
