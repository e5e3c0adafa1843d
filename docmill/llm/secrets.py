"""Secret scans of whole texts with one combined automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.automaton import Automaton, compile_rules, parse, reverse
from docmill.llm.common import byte_values, slices


class Rule(NamedTuple):
    """A rule matches word (letters in either case), then head, then tail.

    Matches shorter than least, or whose tail is shorter than least_tail, are dropped after
    they are matched: what they cover is not searched again. Lengths are in bytes.
    """

    kind: str
    word: bytes
    head: bytes
    tail: bytes
    least: int = 0
    least_tail: int = 0


# The three base rules, then the rules that this operator adds.
RULES = (
    Rule("assign", rb"(password|passwd|secret|token|api_?key)", rb"""["']?\x20*[:=]\x20*["']?""", rb"[A-Za-z0-9+/_.=-]+", least_tail=6),
    Rule("access", b"", b"AKIA", b"[A-Z0-9]+", least=20),
    Rule("hex", b"", b"", b"[0-9a-f]{8,}", least=24),
    Rule("github", b"", b"gh[opsur]_", b"[A-Za-z0-9]+", least=40),
    Rule("slack", b"", b"xox[abprs]-", b"[A-Za-z0-9-]+", least=15),
    Rule("pem", b"", b"-----BEGIN [A-Z ]*PRIVATE KEY-----", b""),
)


class Scanner(NamedTuple):
    """starts: over a text read backwards, tells at which bytes matches of which rules begin. ends and heads: from such a byte on, how far the longest match of each rule, or of its word and head, goes."""

    rules: tuple[Rule, ...]
    starts: Automaton
    ends: Automaton
    heads: Automaton


def compile_scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    heads = [("seq", [parse(r.word, True), parse(r.head)]) for r in rules]
    trees = [("seq", [h, parse(r.tail)]) for h, r in zip(heads, rules, strict=True)]
    return Scanner(rules, compile_rules([reverse(t) for t in trees], search=True), compile_rules(trees, search=False), compile_rules(heads, search=False))


def _loops(a: Automaton) -> dict[int, re.Pattern]:
    """For each state that some bytes leave as it is, a pattern of the others: where a run of such bytes ends is then found at once."""
    own = {}
    for s in range(len(a.accept)):
        stay = bytes(b for b in range(256) if a.step[s * a.n_classes + a.classes[b]] == s * a.n_classes)
        if stay and s * a.n_classes != a.dead:
            own[s * a.n_classes] = re.compile(b"[^" + re.escape(stay) + b"]")
    return own


def _longest(a: Automaton, data: bytes, at: int, want: int) -> int:
    """The end of the longest match from byte `at` of the rule with the bit `want`; -1 without one."""
    if "loops" not in a.extra:
        a.extra["loops"] = _loops(a)
    classes, n, step, accept, dead, loops = a.classes, a.n_classes, a.step, a.accept, a.dead, a.extra["loops"]
    last, state, i, size = -1, 0, at, len(data)
    while True:
        if accept[state // n] & want:
            last = i
        if i == size or state == dead:
            return last
        nxt = step[state + classes[data[i]]]
        i += 1
        if nxt == state and state in loops:
            found = loops[state].search(data, i)
            i = found.start() if found else size
        state = nxt


def _begins(scanner: Scanner, data: bytes, limits: np.ndarray, state: int) -> tuple[list[np.ndarray], int]:
    """For each rule the places [n, 2], begin and end, of runs of bytes at which its matches begin; and the automaton's state at the first byte.

    data: texts one after another, which end at limits; state: the automaton's at the end of
    the last of them, as of a text that goes on. One pass over the bytes, backwards. A byte
    that occurs in no rule sends every state to the first one, so the runs between such bytes
    are read side by side, one array step for the next byte of every run; when few long runs
    are left, they are read one by one.
    """
    a = scanner.starts
    n = a.n_classes
    if "arrays" not in a.extra:
        step = np.array(a.step, np.int32)
        a.extra["arrays"] = step, np.array(a.accept, np.uint32), ~step.reshape(-1, n).any(axis=0), [bits for bits in a.accept for _ in range(n)]
    step, accept, resets, listed_accept = a.extra["arrays"]
    codes = np.frombuffer(data.translate(a.classes), np.uint8)
    cuts = np.flatnonzero(resets[codes])
    first = np.concatenate([limits[:-1], cuts + 1])
    first.sort()
    last = np.concatenate([limits[1:], cuts])
    last.sort()
    size = last - first
    order = np.argsort(-size, kind="stable")
    order = order[: int((size > 0).sum())]
    end, size = last[order], size[order]
    lanes = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if len(size) else 1), side="left")  # runs longer than t
    now = np.zeros(len(order), np.int32)
    now[end == len(data)] = state
    at, bits = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    done = 0
    for done in range(len(lanes)):
        k = int(lanes[done])
        if k < 150:
            break
        place = end[:k] - (done + 1)
        now[:k] = step[now[:k] + codes[place]]
        got = accept[now[:k] // n]
        if got.any():
            hit = np.flatnonzero(got)
            at.append(place[hit])
            bits.append(got[hit])
    runs = [(x, x + 1, b) for x, b in zip(np.concatenate(at).tolist(), np.concatenate(bits).tolist(), strict=True)]
    listed = a.step
    for lane in range(int(lanes[done]) if len(lanes) else 0):
        s, place, before, since = int(now[lane]), int(end[lane]) - done, 0, 0
        for c in codes[int(end[lane] - size[lane]) : place][::-1].tolist():
            s = listed[s + c]
            b = listed_accept[s]
            if b != before:
                if before:
                    runs.append((place, since, before))
                before, since = b, place
            place -= 1
        if before:
            runs.append((place, since, before))
        now[lane] = s
    reached = np.flatnonzero(end - size == 0)
    # Where the first byte is in no rule, the state there is the first one.
    left = int(now[reached[0]]) if len(reached) else (0 if len(data) else state)
    out = []
    spans = np.array(runs, np.int64).reshape(-1, 3)
    for r in range(len(scanner.rules)):
        own = spans[(spans[:, 2] >> r) & 1 == 1, :2]
        own = own[np.argsort(own[:, 0])]
        # Neighbours of one text are one run.
        apart = np.flatnonzero((own[1:, 0] != own[:-1, 1]) | np.isin(own[1:, 0], limits)) + 1 if len(own) else np.empty(0, np.int64)
        heads = np.concatenate([[0], apart]) if len(own) else apart
        tails = np.concatenate([apart - 1, [len(own) - 1]]) if len(own) else apart
        out.append(np.column_stack([own[heads, 0], own[tails, 1]]))
    return out, left


def scan_all(scanner: Scanner, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """scan() of each text."""
    limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    places, _ = _begins(scanner, b"".join(texts), limits, 0)
    edges = [np.searchsorted(p[:, 0], limits) for p in places]
    out = []
    for i, data in enumerate(texts):
        own = [p[e[i] : e[i + 1]] - limits[i] for p, e in zip(places, edges, strict=True)]
        out.append(_resolve(scanner, data, own) if any(len(o) for o in own) else [])
    return out


def scan(scanner: Scanner, data: bytes, block: int = 1 << 21) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, by start, then rule: for each rule its leftmost longest matches that do not overlap.

    A text longer than a block is read block by block from its end on, with the automaton's state carried over.
    """
    state, parts = 0, []
    for end in range(len(data), 0, -block):
        begin = max(0, end - block)
        found, state = _begins(scanner, data[begin:end], np.array([0, end - begin]), state)
        parts.append([f + begin for f in found])
    return _resolve(scanner, data, [np.concatenate([p[r] for p in reversed(parts)]) if parts else np.empty((0, 2), np.int64) for r in range(len(scanner.rules))])


def _resolve(scanner: Scanner, data: bytes, places: list[np.ndarray]) -> list[tuple[int, int, int]]:
    found = []
    for r, (rule, own) in enumerate(zip(scanner.rules, places, strict=True)):
        free = 0  # the first byte after the rule's last match
        for a, b in own.tolist():
            at = max(a, free)
            while at < b:
                end = _longest(scanner.ends, data, at, 1 << r)
                if end - at >= rule.least and (not rule.least_tail or end - _longest(scanner.heads, data, at, 1 << r) >= rule.least_tail):
                    found.append((at, r, end))
                free = at = max(end, at + 1)
    return sorted(found)


def scan_texts(scanner: Scanner, texts: list[bytes], most: int = 1 << 21) -> list[list[tuple[int, int, int]]]:
    """scan() of each text, short ones together."""
    short = iter(scan_all(scanner, [t for t in texts if len(t) < most]))
    return [next(short) if len(t) < most else scan(scanner, t) for t in texts]


def code_point_spans(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not found or data.isascii():
        return found
    places = sorted({x for a, _, b in found for x in (a, b)})
    to, done, count = {}, 0, 0
    for p in places:
        count += len(data[done:p].decode())
        to[p], done = count, p
    return [(to[a], r, to[b]) for a, r, b in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id long, spans array<struct<kind, start, end>>) of each whole text of docs.

    start and end count code points, end exclusive; spans are ordered by start, then by the
    order of the rules. Reads only doc_id and text. A null or empty text has no spans; equal
    texts have equal spans; an empty table gives an empty result.

    The rules are compiled once on the driver into transition arrays of a few kilobytes that
    go out with the job. Every byte of a text is read once, backwards, by the automaton of all
    reversed rules, which marks where matches begin, as runs of bytes for each rule. From the
    first such byte after a rule's last match the match is followed to its end, and its head
    once more where the rule bounds its tail: so a byte is read at most twice more for each
    rule that matches there, and never if none does. Texts are scanned in runs of a few
    megabytes, longer ones in blocks of two, so memory is a few dozen megabytes and the text's
    own size, whatever it holds. One pass over the rows, no shuffle.
    """
    scanner = compile_scanner(rules)
    kinds = [r.kind for r in rules]
    kind = "array<struct<kind:string,start:long,end:long>>"
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in byte_values(part.column("text"))]
                out = [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in code_point_spans(t, f)] for t, f in zip(texts, scan_texts(scanner, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, fields)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, f"doc_id long, spans {kind}")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every secret in text replaced by mask, overlapping ones by a single mask, and n_chars set to the new length.

    All rows and columns stay; a text without secrets, null included, is left as it is, and so is its n_chars.
    """
    scanner = compile_scanner(rules)
    cover = mask.encode()

    def clean(data: bytes | None, found: list[tuple[int, int, int]]) -> bytes | None:
        if not found:
            return data
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [data[at:a], cover]
            at = max(at, b)
        return b"".join([*out, data[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            place = batch.schema.get_field_index("text")
            old = byte_values(batch.column(place))
            new = [clean(t, f) for t, f in zip(old, scan_texts(scanner, [t or b"" for t in old]), strict=True)]
            columns = [*batch.columns]
            columns[place] = pa.array(new, pa.binary()).cast(batch.column(place).type)
            where = batch.schema.get_field_index("n_chars")
            if where >= 0:
                kept = batch.column(where).to_pylist()
                columns[where] = pa.array([k if a is b or a == b else len(b.decode()) for k, a, b in zip(kept, old, new, strict=True)], batch.column(where).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)
