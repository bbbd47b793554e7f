"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every document is a query: windows of ``2 * span`` words that begin every ``span`` words,
``span`` being the longest item (items beyond ``LONGEST`` words are indexed in pieces of that many), so each item
lies whole within one window. An item is retrieved when the passage scores at least ``retrieve`` of what the
item itself would.

The index keeps items in blocks of ``ITEMS_PER_BLOCK`` and, per term and block, the greatest share of its item's own score
that the term can bring. Windows are first held against these maxima in bulk, by array operations: a window
whose maxima do not add up to ``retrieve`` in a block cannot hold an item of it and is skipped. What is left is
searched document at a time with WAND over the postings, block by block.

A retrieved item is verified on the words of the document around the passage: of the five-word shingles of the question
and of the answer (the item's last sentence) at least ``overlap`` each have to be there. One changed word takes away up
to five shingles, all of a short part; so an item is there too if its words are, in order, with at most one in
``WORDS_PER_EDIT`` replaced, added or left out. If the answer has fewer than ``SHORT_ANSWER`` words, and no more than the
question, the same of a question of ``SHORTEST`` words or more is enough.

Words are runs of letters and digits; in scripts without spaces every character is one. An item of fewer than ``SHORTEST``
words is there where all its words follow each other unchanged; such items are looked up by their length and hash.

Defined cases: null and empty texts hold nothing; items null or without a word are left out; an item that is repeated counts under each id; a benchmark without items gives no rows;
other columns are ignored. The index is broadcast: it is measured on the benchmark first, and beyond
``INDEX_WORDS`` words the items are dealt into several indexes, each with its own pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import Hasher, blocks, codepoints, mixed, raw, strings
from tidewake.llm.common import BASE

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP = 0.5, 0.6
LONGEST, SHORTEST = 128, 8
WORDS_PER_EDIT, SHORT_ANSWER = 13, 10
ITEMS_PER_BLOCK = 4
INDEX_WORDS = 4_000_000
SHINGLE = 5
BLOCK = 1 << 20
_WORD = re.compile(r"[^\W_]+")
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)  # odd, one per place in a row of words
# Thai and Lao, Myanmar, Khmer, kana, Han: first and last code points
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
             (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_UNSPACED_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _UNSPACED) + "]"


def _fold() -> np.ndarray:
    """Per code point: its lower case, or 0 where it is no letter or digit."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalnum():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


_FOLD: list[np.ndarray] = []


def word_hashes(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased runs of letters and digits or single unspaced ones, and the text of each."""
    if not _FOLD:
        _FOLD.append(_fold())
    folded = _FOLD[0][points]
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = folded != 0
    cut = np.zeros(len(points) + 1, bool)
    cut[at] = True
    if len(points) and points.max() >= _UNSPACED[0][0]:
        single = np.zeros(len(points), bool)
        for low, high in _UNSPACED:
            single |= (points >= low) & (points <= high)
        cut[:-1] |= single
        cut[1:] |= single
    change = inside[1:] != inside[:-1]
    begin = np.flatnonzero(inside[1:-1] & (change[:-1] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (change[1:] | cut[1:])) + 1
    h = Hasher(mixed(folded.astype(np.uint64) + BASE)).spans(begin, end)
    return h, np.searchsorted(at, begin, side="right") - 1


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    points, at = codepoints(data, np.array([0, len(data)], np.int64))
    return word_hashes(points, at)[0]


def rows_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row, of which there are as many at least."""
    sums = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        sums += words[j:len(words) - k + 1 + j] * _STEP[j]
    return mixed(sums)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of ``k`` words in a row; fewer words are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(rows_of(words, min(k, len(words))))


def question_and_answer(text: str) -> tuple[str, str]:
    """The item without its last sentence, and that; of a single sentence the last third of words is the answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if _WORD.search(p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    every = text.split()
    cut = len(every) - max(1, len(every) // 3)
    return " ".join(every[:cut]), " ".join(every[cut:])


class Index:
    """Inverted index of items with block maxima, in hashes of words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.question, self.answer, pieces = [], [], [], [], []
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in sorted(items):
            h = hashes_of(text)
            if not len(h):
                continue
            if len(h) < SHORTEST:
                short[len(h)].append((int(rows_of(h, len(h))[0]), item_id))
                continue
            question, answer = question_and_answer(text)
            self.ids.append(item_id)
            self.words.append(h)
            self.question.append(hashes_of(question))
            self.answer.append(hashes_of(answer))
            count = math.ceil(len(h) / LONGEST)
            for part in np.array_split(h, count):
                pieces.append((len(self.ids) - 1, part))
        # Short items: per number of words the hashes, ascending, and the id of each.
        self.short = {k: (np.array([h for h, _ in sorted(pairs)], np.uint64), [i for _, i in sorted(pairs)])
                      for k, pairs in short.items()}
        # Pieces of like length share a block: the shares of their terms are alike, and the maxima tight.
        pieces.sort(key=lambda p: len(p[1]))
        self.item = np.array([p[0] for p in pieces], np.int64)
        self.span = max((len(p[1]) for p in pieces), default=1)
        terms = [Counter(part.tolist()) for _, part in pieces]
        in_items = Counter(t for c in terms for t in c)
        mean = sum(len(p) for _, p in pieces) / max(1, len(pieces))
        self.vocabulary = np.array(sorted(in_items), np.uint64)
        number = {t: i for i, t in enumerate(self.vocabulary.tolist())}
        # Postings: per term (item piece, share of that piece's own score), ascending.
        self.postings: list[list[tuple[int, float]]] = [[] for _ in number]
        for piece, (count, (_, part)) in enumerate(zip(terms, pieces)):
            weight = {t: math.log(1 + (len(pieces) - in_items[t] + 0.5) / (in_items[t] + 0.5))
                      * f * (K1 + 1) / (f + K1 * (1 - B + B * len(part) / mean)) for t, f in count.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                self.postings[number[t]].append((piece, w / own))
        self._block_maxima(len(pieces))

    def _block_maxima(self, pieces: int) -> None:
        """Per term and block the greatest share; terms of many blocks are frequent and kept apart.

        What the frequent terms can bring is bounded twice: by those in the window, and per block by the most
        that they make up of any of its pieces.
        """
        self.blocks = max(1, math.ceil(pieces / ITEMS_PER_BLOCK))
        self.most_of: list[float] = []
        self.bounds: list[dict[int, float]] = []
        starts, block, most = [0], [], []
        frequent = np.zeros(pieces)
        self.common = np.zeros(len(self.vocabulary))
        for t, posting in enumerate(self.postings):
            best: dict[int, float] = defaultdict(float)
            for piece, share in posting:
                best[piece // ITEMS_PER_BLOCK] = max(best[piece // ITEMS_PER_BLOCK], share)
            self.bounds.append(dict(best))
            self.most_of.append(max(best.values()))
            if len(best) > max(4, self.blocks // 4):
                self.common[t] = max(best.values())
                for piece, share in posting:
                    frequent[piece] += share
            else:
                block += best
                most += best.values()
            starts.append(len(block))
        self.starts, self.block, self.most = np.array(starts, np.int64), np.array(block, np.int64), np.array(most)
        self.frequent = np.zeros(self.blocks)
        np.maximum.at(self.frequent, np.arange(pieces) // ITEMS_PER_BLOCK, frequent)

    def exact(self, words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """(text, item id) of the short items whose words follow each other in a text."""
        out = []
        for k, (wanted, ids) in self.short.items():
            if len(words) < k:
                continue
            rows = rows_of(words, k)
            at = np.searchsorted(wanted, rows)
            at[at == len(wanted)] = 0
            found = np.flatnonzero((wanted[at] == rows) & (owner[:len(rows)] == owner[k - 1:]))
            for text, first in np.unique(np.stack([owner[found], at[found]], axis=1), axis=0).tolist():
                last = np.searchsorted(wanted, wanted[first], side="right")
                out += [(text, i) for i in ids[first:last]]
        return out

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def passing(self, window: np.ndarray, term: np.ndarray, windows: int, retrieve: float) -> np.ndarray:
        """Windows in which the maxima of some block add up; (window, term) are distinct pairs."""
        shared = np.bincount(window, weights=self.common[term], minlength=windows)
        width = self.starts[term + 1] - self.starts[term]
        first = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        at = first + np.arange(width.sum())
        key = np.repeat(window, width) * self.blocks + self.block[at]
        # a block without any rarer term can pass only if the frequent ones alone can make up the share
        found = (shared >= retrieve - 1e-9) & (self.frequent.max(initial=0.0) >= retrieve - 1e-9)
        distinct, which = np.unique(key, return_inverse=True)
        sums = np.bincount(which, weights=self.most[at], minlength=len(distinct))
        of_window, of_block = distinct // self.blocks, distinct % self.blocks
        bound = sums + np.minimum(shared[of_window], self.frequent[of_block])
        found[of_window[bound >= retrieve - 1e-9]] = True
        return np.flatnonzero(found)

    def search(self, terms: np.ndarray, retrieve: float) -> set[int]:
        """Items of which a passage with these distinct terms has the share ``retrieve``: block-max WAND."""
        lists = [[self.postings[t], 0, self.most_of[t], self.bounds[t]] for t in terms.tolist()]
        out = set()
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, None
            for i, entry in enumerate(lists):
                bound += entry[2]
                if bound >= retrieve - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            target = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == target:
                pivot += 1
            block = target // ITEMS_PER_BLOCK
            if sum(e[3].get(block, 0.0) for e in lists[:pivot + 1]) < retrieve - 1e-9:
                # No item of this block up to the next list's can reach the share.
                goal = (block + 1) * ITEMS_PER_BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][1]][0])
                self._advance(lists[:pivot + 1], max(goal, target + 1))
            elif lists[0][0][lists[0][1]][0] == target:
                score = sum(e[0][e[1]][1] for e in lists[:pivot + 1])
                if score >= retrieve - 1e-9:
                    out.add(int(self.item[target]))
                self._advance(lists[:pivot + 1], target + 1)
            else:
                self._advance(lists[:pivot], target)
            lists = [e for e in lists if e[1] < len(e[0])]
        return out

    @staticmethod
    def _advance(lists: list[list], target: int) -> None:
        for entry in lists:
            posting, at = entry[0], entry[1]
            while at < len(posting) and posting[at][0] < target:
                at += 1
            entry[1] = at


HITS_DDL = "doc_id long, item_id long, question_overlap double, answer_overlap double"


def _share(part: np.ndarray, around: np.ndarray, k: int = SHINGLE) -> float:
    wanted = shingles(part, k)
    return float(np.isin(wanted, shingles(around, min(k, len(part)))).mean()) if len(wanted) else 1.0


def _nearly(part: np.ndarray, around: np.ndarray) -> bool:
    """Whether a run of ``around`` is ``part`` but for one word in ``WORDS_PER_EDIT`` replaced, added or left out."""
    most = len(part) // WORDS_PER_EDIT
    if np.count_nonzero(~np.isin(part, around)) > most:
        return False
    place = np.arange(len(around) + 1)
    edits = np.zeros(len(around) + 1, np.int64)  # of the words so far against the best run that ends here
    for word in part:
        now = edits + 1
        now[1:] = np.minimum(now[1:], edits[:-1] + (around != word))
        edits = np.minimum.accumulate(now - place) + place
    return bool(edits.min() <= most)


def _altered(index: Index, item: int, around: np.ndarray) -> bool:
    """Whether the item, or its question if the answer is short, is there but for single words."""
    question, answer = index.question[item], len(index.answer[item])
    return _nearly(index.words[item], around) or (
        answer < SHORT_ANSWER and len(question) >= max(SHORTEST, answer) and _nearly(question, around))


def _search_task(index: Index, retrieve: float, overlap: float):
    span = index.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", BLOCK):
            points, at = codepoints(*raw(strings(part.column("text"))))
            h, owner = word_hashes(points, at)
            term = index.places(h)
            known = np.flatnonzero(term >= 0)
            # Windows are numbered through all texts; the word in half window w lies in windows w - 1 and w.
            first = np.searchsorted(owner, np.arange(len(at) - 1))
            halves = -(-np.diff(np.append(first, len(h))) // span)
            base = np.concatenate([[0], np.cumsum(halves)[:-1]])
            half = base[owner[known]] + (known - first[owner[known]]) // span
            later = half > base[owner[known]]
            window = np.concatenate([half, half[later] - 1])
            words = np.concatenate([term[known], term[known][later]])
            pair = np.unique(window * len(index.vocabulary) + words)
            window, words = pair // len(index.vocabulary), pair % len(index.vocabulary)
            hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for w in index.passing(window, words, int(halves.sum()), retrieve):
                a, b = np.searchsorted(window, [w, w + 1])
                items = index.search(words[a:b], retrieve)
                if items:
                    doc = int(np.searchsorted(base, w, side="right") - 1)
                    begin = int(first[doc] + (w - base[doc]) * span)
                    end = int(min(begin + 2 * span, first[doc + 1] if doc + 1 < len(first) else len(h)))
                    for item in items:
                        hits[doc, item].append((begin, end))
            rows = [(part.column("doc_id")[doc].as_py(), i, 1.0, 1.0) for doc, i in index.exact(h, owner)]
            for (doc, item), found in hits.items():
                # all words of the passages that retrieved the item, each stretch once
                found.sort()
                stretches = [list(found[0])]
                for begin, end in found[1:]:
                    if begin <= stretches[-1][1]:
                        stretches[-1][1] = max(end, stretches[-1][1])
                    else:
                        stretches.append([begin, end])
                best = (False, 0.0, 0.0, 0.0)  # of the stretches that pass, each for itself, the best
                for begin, end in stretches:
                    low = max(int(first[doc]), begin - span)
                    high = min(end + span, int(first[doc + 1]) if doc + 1 < len(first) else len(h))
                    q, a = (_share(p[item], h[low:high]) for p in (index.question, index.answer))
                    passes = (q >= overlap and a >= overlap) or (not best[0] and _altered(index, item, h[low:high]))
                    best = max(best, (passes, min(q, a), q, a))
                if best[0]:
                    rows.append((part.column("doc_id")[doc].as_py(), index.ids[item], *best[2:]))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())],
                names=["doc_id", "item_id", "question_overlap", "answer_overlap"])

    return run


def leaks(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP,
          id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) of each item that a document holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(
        "id is not null and text is not null")
    unspaced = F.length("text") - F.length(F.regexp_replace("text", _UNSPACED_CLASS, ""))
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+")) + unspaced)).first()[0] or 0
    parts = max(1, math.ceil(size / INDEX_WORDS))
    out = None
    for part in range(parts):
        own = tests.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part) if parts > 1 else tests
        index = Index([(r.id, r.text) for r in own.collect()])
        if not index.ids and not index.short:
            continue
        found = texts.mapInArrow(_search_task(index, retrieve, overlap), HITS_DDL)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], HITS_DDL)
