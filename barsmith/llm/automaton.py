"""Regular expressions to minimal deterministic byte automata.

Expressions (bytes, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}) become one
nondeterministic automaton, which subset construction over byte classes makes
deterministic and partition refinement minimal. Automaton unites rules behind an
implicit "any prefix" and tells in one pass where matches of each may end;
Anchored follows one rule from a place, forwards or (its expression reversed) backwards.
"""

from __future__ import annotations

import numpy as np

_CLASSES = {"d": set(range(48, 58)), "w": set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | {95}, "s": {9, 10, 11, 12, 13, 32}}


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return {int(self.p[self.i - 2 : self.i], 16)}
        return _CLASSES.get(c) or {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))}

    def one(self) -> set[int]:
        """A byte set: literal, escape, dot or bracketed class."""
        c = self.take()
        if c == "\\":
            got = self.escape()
        elif c == ".":
            got = set(range(256)) - {10}
        elif c == "[":
            negate = self.peek() == "^" and bool(self.take())
            got = set()
            while self.peek() != "]":
                c = self.take()
                low = self.escape() if c == "\\" else {ord(c)}
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    c = self.take()
                    high = self.escape() if c == "\\" else {ord(c)}
                    low = set(range(min(low), max(high) + 1))
                got |= low
            self.take()
            if negate:
                got = set(range(256)) - got
        else:
            got = {ord(c)}
        if self.fold:
            got |= {b ^ 32 for b in got if 65 <= (b & ~32) <= 90}
        return got

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            if self.peek() == "(":
                self.take()
                if self.p.startswith("?:", self.i):
                    self.i += 2
                item = self.either()
                self.take()
            else:
                item = ("set", frozenset(self.one()))
            while self.peek() and self.peek() in "?*+{":
                c = self.take()
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
                if c == "{":
                    stop = self.p.index("}", self.i)
                    low, _, high = self.p[self.i : stop].partition(",")
                    high = int(low) if "," not in self.p[self.i : stop] else int(high) if high else None
                    low, self.i = int(low), stop + 1
                item = ("repeat", item, low, high)
            items.append(item)
        return ("seq", items)

    def build(self, node: tuple, start: int) -> int:
        """Adds node's states after start; its end state."""
        if node[0] == "set":
            end = self.state()
            self.edges[start].append((node[1], end))
            return end
        if node[0] == "seq":
            for x in node[1]:
                start = self.build(x, start)
            return start
        if node[0] == "or":
            end = self.state()
            for x in node[1]:
                self.edges[self.build(x, start)].append((None, end))
            return end
        _, item, low, high = node
        for _ in range(low):
            start = self.build(item, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.edges[start].append((None, loop))
            self.edges[self.build(item, loop)].append((None, loop))
            self.edges[loop].append((None, end))
            return end
        self.edges[start].append((None, end))
        for _ in range(high - low):
            start = self.build(item, start)
            self.edges[start].append((None, end))
        return end


def parsed(pattern: str, fold: bool) -> tuple:
    p = _Parser(pattern, fold)
    tree = p.either()
    if p.peek():
        raise ValueError(f"unbalanced expression: {pattern}")
    return tree


def reversed_tree(tree: tuple) -> tuple:
    """The expression of all matches read backwards."""
    if tree[0] == "set":
        return tree
    if tree[0] == "seq":
        return ("seq", [reversed_tree(x) for x in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [reversed_tree(x) for x in tree[1]])
    return ("repeat", reversed_tree(tree[1]), *tree[2:])


def _deterministic(trees: list[tuple], anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(byte classes, table of states x classes, accept bits, first state), minimal; anywhere: matches may start at any byte."""
    edges: list[list[tuple[frozenset[int] | None, int]]] = [[]]
    final: dict[int, int] = {}
    for r, tree in enumerate(trees):
        p = _Parser("", False)
        end = p.build(tree, p.state())
        base = len(edges)
        edges += [[(s, t + base) for s, t in row] for row in p.edges]
        edges[0].append((None, base))
        final[base + end] = 1 << r

    marks = {s for row in edges for s, _ in row if s}
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in marks), len(kinds)) for b in range(256)], np.int32)
    byte_of = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    def closure(states) -> int:
        """The states reached without a byte, as bits."""
        found, todo = set(states), list(states)
        while todo:
            for s, t in edges[todo.pop()]:
                if s is None and t not in found:
                    found.add(t)
                    todo.append(t)
        return sum(1 << x for x in found if x in final or any(s is not None for s, _ in edges[x]))

    after = [[closure([t for s, t in row if s is not None and b in s]) for b in byte_of] for row in edges]
    first = closure([0])
    again = first if anywhere else 0
    numbers, order, table = {first: 0}, [first], []
    for subset in order:
        row, left = [again] * len(byte_of), subset
        while left:
            low = left & -left
            row = [x | y for x, y in zip(row, after[low.bit_length() - 1], strict=True)]
            left ^= low
        for to in row:
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
        table.append([numbers[to] for to in row])
    accept = np.array([sum(bit for x, bit in final.items() if subset >> x & 1) for subset in order], np.int64)
    delta = np.array(table, np.int64)

    group, count = np.unique(accept, return_inverse=True)[1], 0
    while True:
        group = np.unique(np.column_stack([group, group[delta]]), axis=0, return_inverse=True)[1].reshape(-1)
        if group.max() + 1 == count:
            break
        count = int(group.max()) + 1
    keep = np.unique(group, return_index=True)[1]
    return classes, group[delta[keep]], accept[keep], int(group[0])


class Anchored:
    """One rule followed byte by byte from a place."""

    def __init__(self, tree: tuple):
        classes, table, accept, self.first = _deterministic([tree], False)
        self.rows = [[row[c] for c in classes.tolist()] for row in table.tolist()]
        self.accept = accept.astype(bool).tolist()
        dead = [s for s, row in enumerate(table) if not self.accept[s] and (row == s).all()]
        self.dead = dead[0] if dead else -1

    def lengths(self, raw: bytes) -> list[int]:
        """Lengths of the matches that start where raw does."""
        state, out = self.first, []
        for n, b in enumerate(raw, 1):
            state = self.rows[state][b]
            if state == self.dead:
                break
            if self.accept[state]:
                out.append(n)
        return out


class Automaton:
    """All rules in one minimal automaton; bit r of a byte's mark: a match of rule r may end with it."""

    LENGTH, FEW = 1024, 24

    def __init__(self, rules: list[tuple[str, bool]]):
        """rules: (pattern, whether ASCII letters match in either case)."""
        trees = [parsed(*rule) for rule in rules]
        self.classes, table, self.accept, self.first = _deterministic(trees, True)
        self.n_classes = table.shape[1]
        self.table = (table * self.n_classes).astype(np.int32).reshape(-1)
        resets = np.flatnonzero((table == self.first).all(0))
        #: Bytes after which every state is the first state: no match holds one.
        self.resets = np.isin(self.classes, resets)
        self.forward = [Anchored(t) for t in trees]
        self.backward = [Anchored(reversed_tree(t)) for t in trees]

    def _stretches(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Cuts of data, at document bounds and after resetting bytes, about LENGTH apart."""
        reset = np.flatnonzero(self.resets[data]) + 1
        at = np.searchsorted(reset, np.arange(self.LENGTH, len(data), self.LENGTH))
        return np.unique(np.concatenate([off, reset[at[at < len(reset)]]]))

    def marks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One pass over the bytes of documents: the accept bits at each. Independent stretches advance in lockstep while many are left."""
        cuts = self._stretches(data, off)
        start, size = cuts[:-1], np.diff(cuts)
        order = np.argsort(-size, kind="stable")
        at, size = start[order], size[order]
        kinds = self.classes[data]
        state = np.full(len(at), self.first * self.n_classes, np.int32)
        states = np.zeros(len(data), np.int32)
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        few = int(np.searchsorted(-live, -self.FEW, "right"))
        for t, m in enumerate(live[:few].tolist()):
            place = at[:m] + t
            now = self.table[state[:m] + kinds[place]]
            state[:m] = now
            states[place] = now
        if few < len(live):  # the tails of some long stretches
            table = self.table.tolist()
            for k in range(int(live[few])):
                s, a, b = int(state[k]), int(at[k]) + few, int(at[k] + size[k])
                out = []
                for c in kinds[a:b].tolist():
                    s = table[s + c]
                    out.append(s)
                states[a:b] = out
        return np.repeat(self.accept, self.n_classes)[states]

    def spans(self, data: np.ndarray, off: np.ndarray, shortest: dict[int, int] | None = None) -> list[tuple[int, int, int, int]]:
        """(start, end, rule, matching ends met from the start) of each rule's leftmost, longest, non-overlapping matches.

        Rules must end in a class repeated without bound, or in a fixed byte, so that all matches over one run
        of marked bytes end with it. Runs of less than shortest[rule] marked bytes are passed over; that
        is for rules of which a short match never hides a long one.
        """
        found = []
        marks = self.marks(data, off)
        owner = None
        for rule, (forward, backward) in enumerate(zip(self.forward, self.backward, strict=True)):
            on = np.flatnonzero(marks >> rule & 1)
            if not len(on):
                continue
            new = np.ones(len(on), bool)
            new[1:] = on[1:] != on[:-1] + 1
            new |= np.isin(on, off)
            first = np.flatnonzero(new)
            ends = on[np.append(first[1:], len(on)) - 1] + 1
            enough = ends - on[first] >= (shortest or {}).get(rule, 1)
            ends = ends[enough]
            owner = off[np.searchsorted(off, ends - 1, "right") - 1]
            done = 0
            for e, document in zip(ends.tolist(), owner.tolist(), strict=True):
                low = max(done, document)
                back = backward.lengths(data[low:e][::-1].tobytes())
                if back:
                    s = e - back[-1]
                    met = forward.lengths(data[s:e].tobytes())
                    found.append((s, e, rule, len(met)))
                    done = e
        return sorted(found, key=lambda x: (x[0], x[2]))
