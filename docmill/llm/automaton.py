"""Rule regexes compiled into one minimal deterministic automaton over bytes.

Rules use a small regex syntax: literals, escapes (\\xHH and escaped punctuation), classes,
groups, alternation and the repeats ?, *, +, {n} and {n,}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Automaton:
    """step[state * n_classes + class] is the next state times n_classes; accept[state] has bit r set for rule r."""

    classes: bytes  # of 256 entries: the class of each byte
    n_classes: int
    step: list[int]
    accept: list[int]
    dead: int = -1  # state from which nothing is accepted, times n_classes; -1 without one
    extra: dict = field(default_factory=dict)


def _class(pattern: bytes, i: int) -> tuple[frozenset[int], int]:
    """The bytes of the class that starts after '[' at i; the index after ']'."""
    out: set[int] = set()
    while pattern[i : i + 1] != b"]":
        low, i = _literal(pattern, i)
        if pattern[i : i + 1] == b"-" and pattern[i + 1 : i + 2] != b"]":
            high, i = _literal(pattern, i + 1)
            out.update(range(low, high + 1))
        else:
            out.add(low)
    return frozenset(out), i + 1


def _literal(pattern: bytes, i: int) -> tuple[int, int]:
    if pattern[i] != 0x5C:
        return pattern[i], i + 1
    if pattern[i + 1 : i + 2] == b"x":
        return int(pattern[i + 2 : i + 4], 16), i + 4
    return pattern[i + 1], i + 2


def parse(pattern: bytes, ignore_case: bool = False):
    """A tree of ('set', bytes), ('seq', trees), ('alt', trees) and ('rep', tree, least, open end)."""

    def fold(s: frozenset[int]) -> frozenset[int]:
        if not ignore_case:
            return s
        return s | {b ^ 32 for b in s if 65 <= b & ~32 <= 90}

    def alt(i: int):
        options, (tree, i) = [], seq(i)
        options.append(tree)
        while pattern[i : i + 1] == b"|":
            tree, i = seq(i + 1)
            options.append(tree)
        return (options[0] if len(options) == 1 else ("alt", options)), i

    def seq(i: int):
        items = []
        while i < len(pattern) and pattern[i : i + 1] not in (b"|", b")"):
            c = pattern[i : i + 1]
            if c == b"(":
                tree, i = alt(i + 1)
                i += 1
            elif c == b"[":
                s, i = _class(pattern, i + 1)
                tree = ("set", fold(s))
            else:
                b, i = _literal(pattern, i)
                tree = ("set", fold(frozenset([b])))
            while i < len(pattern) and (c := pattern[i : i + 1]) in (b"?", b"*", b"+", b"{"):
                if c == b"{":
                    end = pattern.index(b"}", i)
                    least, _, most = pattern[i + 1 : end].partition(b",")
                    if b"," not in pattern[i:end]:
                        tree, i = ("seq", [tree] * int(least)), end + 1
                        continue
                    if most:
                        raise ValueError("{n,m} is not part of the rule syntax")
                    tree, i = ("seq", [*[tree] * int(least), ("rep", tree, 0, True)]), end + 1
                    continue
                tree, i = ("rep", tree, int(c == b"+"), c != b"?"), i + 1
            items.append(tree)
        return ("seq", items), i

    tree, i = alt(0)
    if i != len(pattern):
        raise ValueError(f"unbalanced rule {pattern!r}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return (kind, [reverse(t) for t in (tree[1][::-1] if kind == "seq" else tree[1])])


def compile_rules(trees: list, search: bool) -> Automaton:
    """Subset construction over all rules at once, then minimisation.

    search: matches may start anywhere (a loop over all bytes is put in front); otherwise
    only at the first byte.
    """
    moves: list[list[tuple[frozenset[int], int]]] = []
    empty: list[list[int]] = []

    def state() -> int:
        moves.append([])
        empty.append([])
        return len(moves) - 1

    def build(tree, a: int) -> int:
        """Adds the tree from state a; returns its end."""
        kind = tree[0]
        if kind == "set":
            b = state()
            moves[a].append((tree[1], b))
            return b
        if kind == "seq":
            for t in tree[1]:
                a = build(t, a)
            return a
        end = state()
        if kind == "alt":
            for t in tree[1]:
                begin = state()
                empty[a].append(begin)
                empty[build(t, begin)].append(end)
            return end
        begin = state()
        empty[a].append(begin)
        last = build(tree[1], begin)
        empty[last].append(end)
        if tree[3]:
            empty[last].append(begin)
        if not tree[2]:
            empty[a].append(end)
        return end

    root = state()
    finals = {}
    for r, tree in enumerate(trees):
        begin = state()
        empty[root].append(begin)
        finals[build(tree, begin)] = 1 << r

    # Bytes that no rule tells apart share a class.
    sets = list(dict.fromkeys(s for m in moves for s, _ in m))
    mark = {}
    classes = bytearray(256)
    for b in range(256):
        classes[b] = mark.setdefault(tuple(b in s for s in sets), len(mark))
    n = len(mark)
    member = {s: sorted({classes[b] for b in s}) for s in sets}

    def closure(states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closure([root])
    ids, rows, accept, todo = {start: 0}, [], [], [start]
    for subset in todo:
        target: list[set[int]] = [set() for _ in range(n)]
        for s in subset:
            for chars, t in moves[s]:
                for c in member[chars]:
                    target[c].add(t)
        row = []
        for c in range(n):
            nxt = closure(target[c] | ({root} if search else set()))
            if nxt not in ids:
                ids[nxt] = len(todo)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
        bits = 0
        for s in subset:
            bits |= finals.get(s, 0)
        accept.append(bits)

    # Moore's refinement: states stay together while their classes' targets do.
    table = np.array(rows)
    part = np.unique(np.array(accept), return_inverse=True)[1]
    while True:
        refined = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == part.max():
            break
        part = refined
    # Number the merged states by first appearance, so that the start is 0.
    order = {}
    for p in part.tolist():
        order.setdefault(p, len(order))
    merged = np.zeros((len(order), n), np.int64)
    bits = [0] * len(order)
    for s, p in enumerate(part.tolist()):
        merged[order[p]] = [order[q] for q in part[table[s]].tolist()]
        bits[order[p]] = accept[s]
    dead = [s for s in range(len(order)) if not bits[s] and (merged[s] == s).all()]
    return Automaton(bytes(classes), n, (merged * n).reshape(-1).tolist(), bits, dead[0] * n if dead and not search else -1)
