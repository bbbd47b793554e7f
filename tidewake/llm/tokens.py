"""Token counts of whole texts under a byte-level BPE vocabulary, without materialising ids.

Texts are cut into pre-tokens by array operations on code point classes. Every block of a few
megabytes posts each distinct pre-token once, with the documents it occurs in and how often. The
postings are shuffled by pre-token; there each distinct pre-token is segmented once, its number of
pieces is joined to the frequencies posted under it, and the products are summed per document.

A posting of more than ``CROWDED`` bytes is keyed by its block as well, so frequent words are spread over
all tasks at the price of a few more segmentations.

Defined cases: a null or empty text has no bytes and no tokens; special strings inside a text count
as one token each, as the tokenizer library has it by default; a repeated row gets a row of its
own; an empty table gives no rows; other columns are ignored. A text beyond ``BLOCK`` bytes is worked on in
pieces cut where a word ends for certain.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import BASE, Hasher, blocks, codepoints, mixed, raw, strings

LIMIT = 512
BLOCK = 8 << 20
FLUSH = 2 << 20

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
CERTAIN_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
POSTINGS_DDL = "token string, block long, posted binary"
# Variable-width lists would be measured again for each row on their way to Python; packed bytes are not.
PAIR = np.dtype([("doc", "<u2"), ("n", "u1")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_bytes", "<i8"), ("special", "<i8")])
BLOCK_ROWS = 1 << 16
CROWDED = 4096  # bytes posted


@functools.lru_cache(2)
def classes(path: str) -> np.ndarray:
    """The class of every code point, as the tokenizer at ``path`` has it.

    Two Unicode tables of different age are at hand; where they differ the tokenizer itself is asked.
    """
    import regex
    from tokenizers import Tokenizer

    out = np.zeros(0x110000, np.uint8)
    newer = np.zeros(0x110000, np.uint8)
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    for point in every:
        out[point] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(point))[0], OTHER)
    whole = "".join(map(chr, every))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for run in regex.finditer(pattern, whole):
            newer[[ord(c) for c in run.group()]] = kind
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for point in np.flatnonzero(out != newer):
        joined = [kind for lead, kind in (("a", LETTER), ("1", NUMBER)) if len(cut(lead + chr(point))) == 1]
        out[point] = joined[0] if joined else OTHER
    for first, last in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[first:last + 1] = BLANK
    return out


def pretokens(points: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; together they cover all code points. ``kinds``: the class of each.

    Runs of letters, of numbers and of other signs are pre-tokens and take one space before them along;
    an apostrophe that begins one and s, t, m, d, re, ve or ll make one; of white space before
    something else the last sign stands apart.
    """
    size = len(points)
    kind = np.zeros(size + 1, np.uint8)
    kind[:-1] = kinds
    cut = np.zeros(size + 1, bool)
    cut[at] = True
    change = np.ones(size + 1, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= cut
    space = np.zeros(size + 1, bool)
    space[1:] = points == 0x20
    led = space & ~cut & (kind != BLANK) & change  # the run here begins with the space before it
    led[-1] = False
    begins = change & ~led
    # the last sign of white space that something follows in the same text
    last = np.flatnonzero(change[1:] & (kind[:-1] == BLANK) & ~cut[1:])
    begins[last] = True

    at_quote = np.flatnonzero((points == 0x27) & begins[:-1] & change[:-1])
    if len(at_quote):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        closed = np.concatenate([cut, np.ones(3, bool)])
        one, two = padded[at_quote + 1], padded[at_quote + 2]
        in_one, in_two = ~closed[at_quote + 1], ~closed[at_quote + 1] & ~closed[at_quote + 2]
        short = in_one & np.isin(one, [ord(c) for c in "stmd"])
        long = in_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                         | ((one == ord("l")) & (two == ord("l"))))
        for where, width in ((at_quote[short], 2), (at_quote[long], 3)):
            begins[where + 1] = False
            after = where + width
            after = after[after < size]
            begins[after[(kind[after] == LETTER) & ~cut[after]]] = True
    return np.flatnonzero(begins[:-1])


def pieces_of(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` whose pre-tokens are those of the whole."""
    while len(text) > size:
        found = CERTAIN_CUT.search(text, size)
        if not found:
            break
        yield text[:found.start()]
        text = text[found.start():]
    yield text


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Fixed-width records as one byte string per row, each row's ending at ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
    ).cast(pa.binary())


def _postings(texts: list[str], docs: np.ndarray, n_docs: int, block: int, path: str) -> pa.RecordBatch:
    """One row per distinct pre-token of ``texts``; ``docs`` has the document of each text."""
    whole = "".join(texts)
    points, _ = codepoints(np.frombuffer(whole.encode(), np.uint8), np.zeros(1, np.int64))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begin = pretokens(points, at, classes(path)[points])
    end = np.concatenate([begin[1:], [len(points)]]).astype(np.int64)
    hashes = Hasher(mixed(points.astype(np.uint64) + BASE)).spans(begin, end)
    owner = docs[np.searchsorted(at, begin, side="right") - 1]
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    pair, count = np.unique(which * n_docs + owner, return_counts=True)
    times = (count + 254) // 255  # a count beyond a byte is posted in several records
    place = np.repeat(pair, times)
    left = np.concatenate([[0], np.cumsum(times)[:-1]])
    rest = np.repeat(count, times) - 255 * (np.arange(len(place)) - np.repeat(left, times))
    posted = np.empty(len(place), PAIR)
    posted["doc"], posted["n"] = place % n_docs, np.minimum(rest, 255)
    last = np.searchsorted(place, np.arange(1, len(distinct) + 1) * n_docs)
    tokens = [whole[b:e] for b, e in zip(begin[first], end[first])]
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens, pa.string()), pa.array(np.full(len(tokens), block)), _packed(posted, last)],
        names=["token", "block", "posted"])


def _posting_task(path: str, special: list[str], id_col: str, text_col: str):
    """Rows of documents to postings, and one row per block with ids, bytes and special strings."""
    split = re.compile("|".join(map(re.escape, special))) if special else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        small = (batch.slice(at, BLOCK_ROWS) for batch in batches for at in range(0, len(batch), BLOCK_ROWS))
        for part in blocks(small, text_col, BLOCK):
            column = strings(part.column(text_col))
            n = len(column)
            about = np.zeros(n, DOCUMENT)
            ids = part.column(id_col)
            about["doc_id"], about["known"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            about["n_bytes"] = np.diff(raw(column)[1])
            texts, docs = [], []
            for i, text in enumerate(column.to_pylist()):
                parts = split.split(text) if split else [text]
                about["special"][i] = len(parts) - 1
                texts += parts
                docs += [i] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.array([block]), _packed(about, np.array([n]))],
                names=["token", "block", "posted"])
            if len(texts) == 1 and len(texts[0]) > BLOCK:
                groups = [([piece], [0]) for piece in pieces_of(texts[0], BLOCK)]
            else:
                groups = [(texts, docs)]
            for some, of in groups:
                if any(some):
                    rows = _postings(some, np.array(of, np.int64), n, block, path)
                    for first in range(0, len(rows), 20_000):
                        yield rows.slice(first, 20_000)
            block += 1

    return run


SUM = np.dtype([("doc", "<u2"), ("n", "<u4")])
SUMS_DDL = "block long, about binary, sums binary"
COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long"


def _counting_task(path: str):
    """Rows sorted by pre-token: segment each distinct one, multiply, sum per block and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        last: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            block, idx, tokens = (np.concatenate(c) for c in zip(*waiting))
            order = np.lexsort((idx, block))
            block, idx, tokens = block[order], idx[order], tokens[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(idx) != 0)]))
            sums = np.empty(len(new), SUM)
            sums["doc"], sums["n"] = idx[new], np.add.reduceat(tokens, new)
            block = block[new]
            last = np.append(np.flatnonzero(np.diff(block)) + 1, len(block))
            return pa.RecordBatch.from_arrays(
                [pa.array(block[last - 1]), pa.nulls(len(last), pa.binary()), _packed(sums, last)],
                names=["block", "about", "sums"])

        for batch in batches:
            about = batch.filter(pa.compute.is_null(batch.column("token")))
            if len(about):
                yield pa.RecordBatch.from_arrays(
                    [about.column("block"), about.column("posted"), pa.nulls(len(about), pa.binary())],
                    names=["block", "about", "sums"])
            batch = batch.filter(pa.compute.is_valid(batch.column("token")))
            if not len(batch):
                continue
            coded = batch.column("token").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = [t for t in distinct if t not in last]
            known = last | dict(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast(
                new, add_special_tokens=False))))
            number = np.array([known[t] for t in distinct], np.int64)[coded.indices.to_numpy()]
            last = {distinct[-1]: known[distinct[-1]]}
            packed = batch.column("posted").cast(pa.large_binary())
            data, at = raw(packed)
            posted, width = np.frombuffer(data.tobytes(), PAIR), np.diff(at) // PAIR.itemsize
            waiting.append((np.repeat(batch.column("block").to_numpy(), width), posted["doc"].astype(np.int32),
                            posted["n"] * np.repeat(number, width)))
            held += len(posted)
            if held > FLUSH:
                yield flush()
                waiting, held = [], 0
        if waiting:
            yield flush()

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """All sums of one block added up, a row per document."""
    about = np.frombuffer(rows.column("about").drop_null()[0].as_buffer(), DOCUMENT)
    tokens = about["special"].copy()
    for packed in rows.column("sums").drop_null():
        sums = np.frombuffer(packed.as_buffer(), SUM)
        tokens[sums["doc"]] += sums["n"]
    return pa.table({"doc_id": pa.array(about["doc_id"].copy(), mask=about["known"] == 0),
                     "n_bytes": about["n_bytes"].copy(), "n_tokens": tokens})


def special_strings(path: str) -> list[str]:
    """Strings the tokenizer file sets apart inside texts."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file that every machine has.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    postings = rows.mapInArrow(_posting_task(tokenizer, special_strings(tokenizer), "doc_id", "text"), POSTINGS_DDL)
    crowded = F.col("token").isNull() | (F.octet_length("posted") > CROWDED)
    by_token = (postings.repartition(F.xxhash64("token"), F.when(crowded, F.col("block")))
                .sortWithinPartitions("token"))
    sums = by_token.mapInArrow(_counting_task(tokenizer), SUMS_DDL)
    # A block has as many rows here as tasks that held its pre-tokens, each with a few bytes per document.
    return (sums.groupBy("block").applyInArrow(_totals, COUNTS_DDL)
            .withColumn("over_limit", F.col("n_tokens") > limit))
