"""Regular expressions over bytes compiled into one minimal deterministic automaton of transition arrays.

Supported syntax: literals, escapes (\\xHH, \\n, \\t, \\r and escaped punctuation), [classes], (groups), |, ?, *, +,
{n}, {n,}, {n,m}.  Thompson's construction gives each rule a nondeterministic automaton; all of them, each able to
begin anywhere, are made deterministic together by subset construction and minimised by partition refinement.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class Nfa:
    """States with byte-class edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1


class Parser:
    """Recursive descent over one rule; each method returns (first state, last state)."""

    def __init__(self, nfa: Nfa, rule: str, either_case: bool = False):
        self.nfa, self.rule, self.at, self.either_case = nfa, rule, 0, either_case

    def peek(self) -> str:
        return self.rule[self.at] if self.at < len(self.rule) else ""

    def take(self) -> str:
        self.at += 1
        return self.rule[self.at - 1]

    def alternatives(self) -> tuple[int, int]:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        a, b = self.nfa.state(), self.nfa.state()
        for x, y in branches:
            self.nfa.empty[a].append(x)
            self.nfa.empty[y].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.nfa.state()
        while self.peek() and self.peek() not in "|)":
            x, y = self.repeated()
            self.nfa.empty[b].append(x)
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        start = self.at
        part = self.atom()
        end = self.at
        least, most = 1, 1
        if self.peek() and self.peek() in "?*+":
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.take()]
        elif self.peek() == "{":
            self.take()
            body = self.rule[self.at : (close := self.rule.index("}", self.at))]
            self.at = close + 1
            low, comma, high = body.partition(",")
            least, most = int(low), (int(high) if high else None) if comma else int(low)
        after = self.at

        def again() -> tuple[int, int]:
            self.at = start
            out = self.atom()
            assert self.at == end
            return out

        a = b = self.nfa.state()
        for k in range(max(least, most or least)):
            x, y = part if k == 0 else again()
            self.nfa.empty[b].append(x)
            if k >= least:  # optional copy
                self.nfa.empty[b].append(y)
            b = y
        if most is None:
            x, y = again() if least else part
            loop = self.nfa.state()
            self.nfa.empty[b].append(loop)
            self.nfa.empty[loop].append(x)
            self.nfa.empty[y].append(loop)
            b = loop
        self.at = after
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            if self.rule.startswith("?:", self.at):
                self.at += 2
            out = self.alternatives()
            assert self.take() == ")"
            return out
        chars = self.char_class() if c == "[" else {self.escaped() if c == "\\" else ord(c)}
        if self.either_case:
            chars = chars | {x ^ 32 for x in chars if chr(x).isascii() and chr(x).isalpha()}
        a, b = self.nfa.state(), self.nfa.state()
        self.nfa.edges[a].append((frozenset(chars), b))
        return a, b

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.rule[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> set[int]:
        out: set[int] = set()
        negated = self.peek() == "^"
        self.at += negated
        while self.peek() != "]":
            c = self.take()
            low = high = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.rule[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            out.update(range(low, high + 1))
        self.take()
        return set(range(256)) - out if negated else out


class Dfa:
    """All rules in one automaton.

    byte_class[b] is the class of byte b; step[state * classes + class] is the next state, already times classes;
    marks[state] has bit k set if rule k has just matched.  Accepting states are numbered last, from first_mark on.
    resets[b]: byte b leads to the start from every state, so scanning may begin anew after it; pair_resets[class *
    classes + class]: the same of two bytes in turn.
    """

    def __init__(self, rules: list[tuple[str, bool]]):
        nfa = Nfa()
        begin = nfa.state()
        ends: dict[int, int] = {}
        for k, (rule, either_case) in enumerate(rules):
            parser = Parser(nfa, rule, either_case)
            a, b = parser.alternatives()
            assert parser.at == len(rule), rule
            nfa.empty[begin].append(a)
            ends[b] = k
        self.byte_class, representatives = self._classes(nfa)
        table, marks = self._subsets(nfa, begin, ends, representatives)
        table, marks = self._minimise(table, marks)
        n = len(representatives)
        order = np.argsort(marks != 0, kind="stable")  # accepting states last
        order = np.concatenate([[0], order[order != 0]]) if marks[0] == 0 else order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.classes = n
        self.table = place[table[order]].astype(np.int32)
        self.marks = marks[order]
        self.first_mark = int(np.argmax(self.marks != 0)) if (self.marks != 0).any() else len(order)
        self.step = (self.table * n).astype(np.int32).ravel()
        self.resets = np.array([bool((self.table[:, c] == 0).all()) for c in self.byte_class])
        # two bytes that lead to the start from every state
        pairs = np.array([[bool((self.table[np.unique(self.table[:, c]), d] == 0).all()) for d in range(n)] for c in range(n)])
        self.pair_resets = pairs.ravel()

    @staticmethod
    def _classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
        """Bytes that no edge tells apart share a class."""
        told = defaultdict(list)
        sets = {chars for edges in nfa.edges for chars, _ in edges}
        for b in range(256):
            told[tuple(b in s for s in sets)].append(b)
        classes = np.zeros(256, np.uint8)
        for k, members in enumerate(told.values()):
            classes[members] = k
        return classes, [m[0] for m in told.values()]

    @staticmethod
    def _subsets(nfa: Nfa, begin: int, ends: dict[int, int], representatives: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sets of states as the bits of one number."""

        def closure(s: int) -> int:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return sum(1 << x for x in seen if nfa.edges[x] or x in ends)

        after = [[0] * len(representatives) for _ in nfa.edges]
        for s, edges in enumerate(nfa.edges):
            for chars, t in edges:
                reached = closure(t)
                for k, b in enumerate(representatives):
                    if b in chars:
                        after[s][k] |= reached
        start = closure(begin)
        numbers, queue, rows = {start: 0}, [start], []
        for states in queue:
            members = [s for s in range(states.bit_length()) if states >> s & 1 and nfa.edges[s]]
            row = []
            for k in range(len(representatives)):
                new = start  # a match may begin anywhere
                for s in members:
                    new |= after[s][k]
                if new not in numbers:
                    numbers[new] = len(queue)
                    queue.append(new)
                row.append(numbers[new])
            rows.append(row)
        marks = np.array([sum(1 << k for k in {k for s, k in ends.items() if states >> s & 1}) for states in queue], np.int64)
        return np.array(rows, np.int64), marks

    @staticmethod
    def _minimise(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partition refinement to the coarsest partition that marks and steps respect; the start stays state 0."""
        block = np.unique(marks, return_inverse=True)[1].reshape(-1)
        while True:
            signature = np.column_stack([block, block[table]])
            new = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == block.max():
                break
            block = new
        order = [block[0], *(b for b in range(block.max() + 1) if b != block[0])]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        block = place[block]
        chosen = np.zeros(len(order), np.int64)
        chosen[block[::-1]] = np.arange(len(block))[::-1]
        return block[table[chosen]], marks[chosen]

    def scan(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(positions after which some rule matched, marks there) in one pass over the bytes, begun at the start state.

        The bytes are cut after resetting pairs of bytes into about so many stretches, which step through the automaton side by
        side; as every stretch begins in the start state, the result is that of one pass from the first byte.
        """
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        classes = self.byte_class[data].astype(np.int32)
        resets = np.flatnonzero(self.pair_resets[classes[:-1] * self.classes + classes[1:]]) + 2
        wanted = np.arange(1, lanes, dtype=np.int64) * max(64, len(data) // lanes)
        wanted = wanted[wanted < len(data)]
        cuts = resets[np.minimum(np.searchsorted(resets, wanted), len(resets) - 1)] if len(resets) else resets
        edges = np.unique(np.concatenate([[0], cuts, [len(data)]])).astype(np.int64)
        starts, lengths = edges[:-1], np.diff(edges)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(starts), np.int32)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # stretches longer than t
        floor, at, marks = self.first_mark * self.classes, [], []
        for t in range(int(lengths[0])):
            n = int(alive[t])
            place = starts[:n] + t
            state = self.step[state[:n] + classes[place]]
            if n and int(state.max()) >= floor:
                hit = np.flatnonzero(state >= floor)
                at.append(place[hit])
                marks.append(self.marks[state[hit] // self.classes])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate(at)
        order = np.argsort(found)
        return found[order], np.concatenate(marks)[order]
