"""Regular expressions over bytes as one minimal deterministic automaton.

Patterns are made of literals, ``[...]`` classes, groups, ``|``, ``? * +`` and ``{n}``, ``{n,}``; that is what secret
rules use. Each becomes an automaton by Thompson's construction; all together are made
deterministic by subset construction over classes of bytes that no pattern tells apart, and minimised by refining
partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Nfa:
    """States with moves on sets of bytes and without input."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


class _Pattern:
    """A recursive-descent reader that builds fragments (first, last) of an ``Nfa``."""

    def __init__(self, text: str, any_case: bool, nfa: Nfa):
        self.text, self.at, self.any_case, self.nfa = text, 0, any_case, nfa

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        first, last = self.nfa.state(), self.nfa.state()
        for a, b in parts:
            self.nfa.free[first].append(a)
            self.nfa.free[b].append(last)
        return first, last

    def sequence(self) -> tuple[int, int]:
        first = last = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.free[last].append(a)
            last = b
        return first, last

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        atom = self.atom()
        end = self.at
        sign = self.peek()
        if sign not in ("?", "*", "+", "{"):
            return atom
        self.take()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, None))
        if sign == "{":
            low, high = self.bounds()
        after = self.at

        def again() -> tuple[int, int]:
            self.at = begin
            out = self.atom()
            assert self.at == end
            return out

        first = last = self.nfa.state()
        copies = [atom] + [again() for _ in range(max(low, 1) - 1)]
        for i, (a, b) in enumerate(copies):
            if i >= low:  # the one optional copy of ? and *
                out = self.nfa.state()
                self.nfa.free[last] += [a, out]
                self.nfa.free[b].append(out)
                if high is None:
                    self.nfa.free[b].append(a)
                last = out
            else:
                self.nfa.free[last].append(a)
                last = b
                if high is None and i == len(copies) - 1:
                    self.nfa.free[b].append(a)
        self.at = after
        return first, last

    def bounds(self) -> tuple[int, int | None]:
        inside = self.text[self.at:self.text.index("}", self.at)]
        self.at += len(inside) + 1
        low, comma, _ = inside.partition(",")
        return int(low), None if comma else int(low)

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            inside = self.either()
            self.take()
            return inside
        if c == "[":
            return self.step(self.bytes_in_class())
        if c == "\\":
            return self.step(self.escaped())
        return self.step({ord(c)})

    def escaped(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2:self.at], 16)}
        return {ord(c)}

    def bytes_in_class(self) -> set[int]:
        out: set[int] = set()
        while self.peek() != "]":
            low = self.escaped() if self.peek() == "\\" and self.take() else {ord(self.take())}
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                low = set(range(min(low), ord(self.take()) + 1))
            out |= low
        self.take()
        return out

    def step(self, accepted: set[int]) -> tuple[int, int]:
        if self.any_case:
            letters = {b for b in accepted if chr(b).isascii() and chr(b).isalpha()}
            accepted = accepted | {b ^ 0x20 for b in letters}
        first, last = self.nfa.state(), self.nfa.state()
        self.nfa.moves[first].append((frozenset(accepted), last))
        return first, last


@dataclass
class Dfa:
    """``table[state * 256 + byte]`` is the next state times 256; states from ``accepting`` on have marks."""

    table: np.ndarray
    start: int
    accepting: int
    marks: np.ndarray  # a bit per pattern
    dead: int


def compile_all(patterns: list[tuple[str, bool]], anywhere: bool = False, reverse: bool = False) -> Dfa:
    """All (pattern, any case) as one automaton.

    ``anywhere``: a match may begin at any byte, and is told at its earliest end only; without paths beyond
    it, rules with open ends do not multiply each other's states.
    """
    nfa = Nfa()
    ends, starts = {}, set()
    for i, (text, any_case) in enumerate(patterns):
        first, last = _Pattern(text, any_case, nfa).either()
        ends[last] = i
        starts.add(first)
    if reverse:
        nfa, ends, starts = _reversed(nfa, ends, starts)
    group, groups = _byte_groups(nfa)
    start = nfa.closure(starts)
    told = {s: frozenset(nfa.closure({s}) & ends.keys()) for s in range(len(nfa.moves))} if anywhere else {}
    number, todo, rows = {start: 0}, [start], []
    while todo:
        here = todo.pop(0)
        row = []
        for b in groups:
            target = {t for s in here for accepted, t in nfa.moves[s] if b in accepted}
            if anywhere:
                over = {e for s in target for e in told[s]}
                target = nfa.closure({s for s in target if not told[s]} | starts) | over
            else:
                target = nfa.closure(target)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    marks = np.zeros(len(number), np.int64)
    for states, i in number.items():
        for s in states:
            if s in ends:
                marks[i] |= 1 << ends[s]
    return _minimal(np.array(rows), marks, group)


def _reversed(nfa: Nfa, ends: dict[int, int], starts: set[int]) -> tuple[Nfa, dict[int, int], set[int]]:
    out = Nfa([[] for _ in nfa.moves], [[] for _ in nfa.free])
    for s, moves in enumerate(nfa.moves):
        for accepted, t in moves:
            out.moves[t].append((accepted, s))
    for s, free in enumerate(nfa.free):
        for t in free:
            out.free[t].append(s)
    return out, dict.fromkeys(starts, 0), set(ends)


def _byte_groups(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
    """A group per byte, equal for bytes that no move tells apart, and one byte of each group."""
    every = list(dict.fromkeys(accepted for moves in nfa.moves for accepted, _ in moves))
    seen: dict[tuple[bool, ...], int] = {}
    group, one = np.zeros(256, np.int64), []
    for b in range(256):
        sign = tuple(b in accepted for accepted in every)
        if sign not in seen:
            seen[sign] = len(seen)
            one.append(b)
        group[b] = seen[sign]
    return group, one


def _minimal(rows: np.ndarray, marks: np.ndarray, group: np.ndarray) -> Dfa:
    """Merge states that no input tells apart; accepting states come last."""
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        sign = np.column_stack([part, part[rows]])
        new = np.unique(sign, axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    first = np.unique(part, return_index=True)[1]
    rows, marks, start = part[rows[first]], marks[first], part[0]
    order = np.argsort(marks > 0, kind="stable")
    place = np.argsort(order)
    rows, marks = place[rows[order]], marks[order]
    table = (rows[:, group] * 256).astype(np.int64).ravel()
    own = np.arange(len(rows))
    stuck = np.flatnonzero((rows == own[:, None]).all(axis=1) & (marks == 0))
    dead = int(stuck[0]) * 256 if len(stuck) else -1
    return Dfa(table, int(place[start]) * 256, int((marks == 0).sum()) * 256, marks, dead)
