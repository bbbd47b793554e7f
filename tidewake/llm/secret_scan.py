"""Secrets in whole texts: all rules in one automaton, one pass over the bytes.

The rules' regular expressions are compiled together (``automata``): subset construction, minimisation, one
flat transition array. A text is read byte by byte once; only where a state accepts a rule is more
done: an automaton of the reversed rule runs back to the leftmost start after the last match of that
rule, one of the rule itself forward to the longest end. The match is then held against the rule's least length and
is dropped without another try if it fails. (A rule needs the property that a match that begins
earlier is not completed later than one that begins inside it; all rules here have it.)

Spans are in code points, end exclusive. Defined cases: a null text is empty; empty tables give no
rows; repeated rows each have theirs; other columns are ignored; a text of any length is one pass in constant memory
beside the text itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import length_hint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.automata import compile_all
from tidewake.llm.common import strings


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    least: int = 1  # characters of the match, or of its value
    value: str = ""  # what stands before the value that ``least`` counts


# The base rules and public token formats.
_KEY = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE_RULES = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=\-]+", True, 8, _KEY),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\-]+", least=20),
    Rule("cloud", r"AIza[A-Za-z0-9_\-]+", least=39),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", least=40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._%+\-]+:[A-Za-z0-9._%+\-]+@"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The compiled rules; plain lists, so that it travels to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        one = compile_all([(r.pattern, r.any_case) for r in rules], anywhere=True)
        self.table, self.start, self.accepting = one.table.tolist(), one.start, one.accepting
        self.marks = [[i for i in range(len(rules)) if m >> i & 1] for m in one.marks.tolist()]
        self.ahead, self.back = [], []
        for r in rules:
            for where, reverse in ((self.ahead, False), (self.back, True)):
                d = compile_all([(r.pattern, r.any_case)], reverse=reverse)
                where.append((d.table.tolist(), d.start, d.accepting, d.dead))
        self.fails = [self._fails(r) for r in rules]

    def __getstate__(self):
        return self.rules, self.table, self.start, self.accepting, self.marks, self.ahead, self.back

    def __setstate__(self, state):
        (self.rules, self.table, self.start, self.accepting, self.marks, self.ahead, self.back) = state
        self.fails = [self._fails(r) for r in self.rules]

    @staticmethod
    def _fails(rule: Rule) -> Callable[[str], bool]:
        lead = re.compile(rule.value, re.IGNORECASE if rule.any_case else 0) if rule.value else None

        def fails(match: str) -> bool:
            return len(match) - (lead.match(match).end() if lead else 0) < rule.least

        return fails

    @staticmethod
    def _run(machine: tuple, data: bytes) -> int:
        """The length of the longest accepted beginning of ``data``, 0 if there is none."""
        table, state, accepting, dead = machine
        longest = 0
        for n, b in enumerate(data, 1):
            state = table[state + b]
            if state >= accepting:
                longest = n
            elif state == dead:
                break
        return longest

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, begin, end) in bytes, of one text."""
        table, state, accepting = self.table, self.start, self.accepting
        done = [0] * len(self.rules)
        out = []
        size, left = len(data), iter(data)
        for b in left:
            state = table[state + b]
            if state >= accepting:
                at = size - length_hint(left)
                for rule in self.marks[state >> 8]:
                    if at <= done[rule]:
                        continue
                    width = self._run(self.back[rule], data[done[rule]:at][::-1])
                    if not width:
                        continue  # it would begin inside the match before
                    begin = at - width
                    end = begin + self._run_from(self.ahead[rule], data, begin)
                    done[rule] = end
                    if not self.fails[rule](data[begin:end].decode("ascii")):
                        out.append((rule, begin, end))
        return out

    @staticmethod
    def _run_from(machine: tuple, data: bytes, begin: int) -> int:
        table, state, accepting, dead = machine
        longest = 0
        for at in range(begin, len(data)):
            state = table[state + data[at]]
            if state >= accepting:
                longest = at + 1 - begin
            elif state == dead:
                break
        return longest


FOUND_DDL = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
             "found array<struct<kind:string,begin:int,end:int>>")


def _scan_task(scanner: Scanner):
    base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                data = text.as_buffer().to_pybytes()
                found = scanner.spans(data)
                if found and not data.isascii():
                    found = [(r, len(data[:b].decode()), len(data[:e].decode())) for r, b, e in found]
                found.sort(key=lambda x: (x[1], x[0]))
                shown = [f"{scanner.rules[r].kind}:{b}:{e}" for r, b, e in found]
                of_base = ",".join(s for s, (r, _, _) in zip(shown, found) if r < base)
                count = [sum(r == i for r, _, _ in found) for i in range(base)]
                rows.append((doc_id, *count, hashlib.sha256(of_base.encode()).hexdigest(), ",".join(shown),
                             [{"kind": scanner.rules[r].kind, "begin": b, "end": e} for r, b, e in found]))
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [span]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                                                    "spans", "found"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and digest of the base matches, all spans as text and as structures."""
    scanner = Scanner()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan_task(scanner), FOUND_DDL)
