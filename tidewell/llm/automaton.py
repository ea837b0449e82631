"""Regular expressions over bytes -> one minimal deterministic automaton for all rules.

The syntax is the part of regular expressions that scanners need: literals, ``\\xHH`` and
escaped punctuation, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
Thompson construction gives a nondeterministic automaton; subset construction over
byte-equivalence classes and partition refinement give the transition arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent to a tree of ('set', bytes) / ('cat', [..]) / ('alt', [..]) / ('rep', node, m, n)."""

    def __init__(self, pattern: str, fold_case: bool):
        self.p, self.i, self.fold = pattern, 0, fold_case

    def parse(self):
        tree = self._alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _alt(self):
        branches = [self._cat()]
        while self._peek() == "|":
            self.i += 1
            branches.append(self._cat())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def _cat(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat())
        return ("cat", parts)

    def _repeat(self):
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.i += 1
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self._alt()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self._class())
        return ("set", self._folded({self._char()}))

    def _char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _class(self) -> frozenset[int]:
        self.i += 1
        negate = self._peek() == "^"
        self.i += negate
        members: set[int] = set()
        while self._peek() != "]":
            low = self._char()
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                members.update(range(low, self._char() + 1))
            else:
                members.add(low)
        self.i += 1
        members = set(self._folded(members))
        return frozenset(set(range(256)) - members if negate else members)

    def _folded(self, members: set[int]) -> frozenset[int]:
        if self.fold:
            members = members | {x ^ 0x20 for x in members if chr(x).isascii() and chr(x).isalpha()}
        return frozenset(members)


def _reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reverse(x) for x in tree[1]])
    return ("rep", _reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Appends ``tree`` after state ``at``; returns the state after it."""
        kind = tree[0]
        if kind == "set":
            to = self.state()
            source = self.state()
            self.empty[at].append(source)
            self.steps[source] = (tree[1], to)
            return to
        if kind == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        out = self.state()
        if kind == "alt":
            for branch in tree[1]:
                self.empty[self.add(branch, at)].append(out)
            return out
        _, node, low, high = tree
        for _ in range(low):
            at = self.add(node, at)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(node, loop)].append(loop)
            self.empty[loop].append(out)
            return out
        for _ in range(high - low):
            self.empty[at].append(out)
            at = self.add(node, at)
        self.empty[at].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``step[state * classes + class_of[byte]]`` is the next state times ``classes``.

    States from ``accepting // classes`` on accept; ``rules`` names which rules each accepts.
    State 0 is the start; ``dead`` (times ``classes``) is the state without a way out, or -1.
    """

    class_of: bytes
    classes: int
    step: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int


def compile_dfa(trees: list, anywhere: bool) -> Dfa:
    """Subset construction of all trees at once, then minimisation.

    ``anywhere``: matches may begin at every byte, not only at the first.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = [nfa.add(tree, start) for tree in trees]
    sets = {s[0] for s in nfa.steps if s}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    index = {sig: k for k, sig in enumerate(dict.fromkeys(signature))}
    class_of = bytes(index[sig] for sig in signature)
    sample = [class_of.index(k) for k in range(len(index))]

    initial = nfa.closure([start])
    known, order, table = {initial: 0}, [initial], []
    for subset in order:  # grows while it runs
        moves = [nfa.steps[s] for s in subset if nfa.steps[s]]
        row = []
        for byte in sample:
            target = nfa.closure([to for members, to in moves if byte in members])
            if anywhere:
                target |= initial
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        table.append(row)
    accepts = [tuple(k for k, end in enumerate(ends) if end in subset) for subset in order]
    return _minimal(np.array(table), accepts, class_of)


def _minimal(table: np.ndarray, accepts: list[tuple[int, ...]], class_of: bytes) -> Dfa:
    """Merges states that no input tells apart: blocks split by their successors' blocks until stable."""
    labels = {a: k for k, a in enumerate(sorted(set(accepts)))}
    block = np.array([labels[a] for a in accepts])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count, classes = int(block.max()) + 1, table.shape[1]
    first = np.full(count, -1)
    for state in range(len(block) - 1, -1, -1):
        first[block[state]] = state
    # plain states first, accepting ones last: one comparison tells them apart in the scan
    rank = sorted(range(count), key=lambda b: (bool(accepts[first[b]]), first[b]))
    place = np.empty(count, dtype=np.int64)
    place[rank] = np.arange(count)
    step = place[block[table[first[rank]]]]
    plain = sum(1 for b in rank if not accepts[first[b]])
    rules = {int(place[b]) * classes: accepts[first[b]] for b in rank if accepts[first[b]]}
    dead = [k for k in range(plain) if (step[k] == k).all()]
    one = [k * classes for k in range(count)]  # one object for each state: the array stays in the CPU's cache
    return Dfa(
        class_of, classes, [one[k] for k in step.ravel().tolist()], int(place[block[0]]) * classes,
        plain * classes, rules, dead[0] * classes if dead else -1,
    )


class Scanner:
    """All rules in one pass over the bytes.

    The combined automaton tells, after each byte, which rules have a match ending there. Only
    then are that rule's own backward and forward automata run, to find where the leftmost
    match starts and how far the longest goes. For rules whose first ending belongs to their
    leftmost match (no rule's separator may contain another match of itself) this equals
    leftmost-longest, non-overlapping matching per rule, in one pass whatever their number.

    The combined automaton knows nothing of matches already taken, so it may tell of one that
    begins inside the last. The rule's own automaton, started where that ended, then finds the
    next ending that counts, and the rule is not looked at before it: each byte is read a
    bounded number of times for each rule, so the time is in proportion to the text.
    """

    def __init__(self, patterns: list[tuple[str, bool]]):
        trees = [_Parser(p, fold).parse() for p, fold in patterns]
        self.combined = compile_dfa(trees, anywhere=True)
        self.alone = [compile_dfa([t], anywhere=True) for t in trees]
        self.forward = [compile_dfa([t], anywhere=False) for t in trees]
        self.backward = [compile_dfa([_reverse(t)], anywhere=False) for t in trees]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of every match, as byte offsets, in order of detection."""
        dfa = self.combined
        step, state, accepting, rules = dfa.step, dfa.start, dfa.accepting, dfa.rules
        used = [0] * len(self.forward)
        quiet = [0] * len(self.forward)  # no ending before this place counts
        found = []
        for at, c in enumerate(data.translate(dfa.class_of)):
            state = step[state + c]
            if state >= accepting:
                for rule in rules[state]:
                    if at < quiet[rule]:
                        continue
                    start = self._start(rule, data, at + 1, used[rule])
                    if start >= 0:
                        quiet[rule] = used[rule] = self._end(rule, data, start)
                        found.append((rule, start, used[rule]))
                    else:
                        quiet[rule] = self._next(rule, data, used[rule])
        return found

    def _start(self, rule: int, data: bytes, end: int, floor: int) -> int:
        dfa, best = self.backward[rule], -1
        state, class_of, step = dfa.start, dfa.class_of, dfa.step
        for at in range(end - 1, floor - 1, -1):
            state = step[state + class_of[data[at]]]
            if state >= dfa.accepting:
                best = at
            elif state == dfa.dead:
                break
        return best

    def _next(self, rule: int, data: bytes, floor: int) -> int:
        """The last byte of the first match that begins at ``floor`` or later; the text's length if there is none."""
        dfa = self.alone[rule]
        state, class_of, step = dfa.start, dfa.class_of, dfa.step
        for at in range(floor, len(data)):
            state = step[state + class_of[data[at]]]
            if state >= dfa.accepting:
                return at
        return len(data)

    def _end(self, rule: int, data: bytes, start: int) -> int:
        dfa, best = self.forward[rule], start
        state, class_of, step = dfa.start, dfa.class_of, dfa.step
        for at in range(start, len(data)):
            state = step[state + class_of[data[at]]]
            if state >= dfa.accepting:
                best = at + 1
            elif state == dfa.dead:
                break
        return best
