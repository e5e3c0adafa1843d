import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docmill.llm import repair


def brute_audit(rows):
    """(cost, audit, lines) of the cheapest least edits of rows (initial, code-like flags, role, text): all prefixes by state, the least kept."""
    best = {"0": (0, "", ())}

    def better(table, s, cost, audit, lines):
        if s not in table or (cost, audit) < table[s][:2]:
            table[s] = (cost, audit, lines)

    turn = {"0": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}

    def inserted(table):
        for _ in range(3):
            for s, (cost, audit, lines) in list(table.items()):
                to, role = turn[s]
                better(table, to, cost + 5, audit + "I", (*lines, f"{role}:"))
        return table

    for must_go, cut, role, text in rows:
        now = {}
        for s, (cost, audit, lines) in inserted(best).items():
            better(now, s, cost + 2, audit + "D", lines)
            if must_go:
                continue
            extra, first = 5 * cut, role[:1]
            if (first == "s" and s == "0") or first == turn[s][0]:
                better(now, first, cost + extra, audit + "K", (*lines, f"{role}:{text}"))
            to, name = turn[s]
            better(now, to, cost + extra + 1, audit + "R", (*lines, f"{name}:{text}"))
        best = now
    return min(v for s, v in inserted(best).items() if s in "0a")


def brute(rows):
    conv = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conv[c] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, rows in conv.items():
        rows.sort()
        turns = [t for known, t, _, _ in rows if known]
        faults, seen = [], set()
        for _, _, role, text in rows:
            ended = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not ended else "duplicate" if (role, text) in seen else "" if ended[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = brute_audit([(f in ("blank", "duplicate"), f == "truncated", r[2], r[3]) for f, r in zip(faults, rows)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'p' as part", "1 as pos", "'c' as code")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.repair_conversations(df, **kw).collect()}
    want = brute(rows)
    assert set(got) == {r[0] for r in rows}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for c in got:
        assert got[c] == want.get(c, nothing), c


def random_rows(seed, n, longest):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "u", "", None, "Assistant", "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "no", "", None, " \n", "Why?", "A longer\nanswer. ", "é!", "x" * 9000 + "."]
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = roles[rng.randrange(len(roles))] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            text = texts[rng.randrange(len(texts))] if rng.random() < 0.5 else f"text {c} {t}" + "." * rng.randrange(2)
            rows.append((c, None if rng.random() < 0.05 else t * (1 + (rng.random() < 0.1)), role, text))
    return rows


@pytest.mark.parametrize(("chunk", "rows_per_piece"), [(4, 1 << 17), (1, 5), (3, 9)])
def test_against_all_prefixes(spark, chunk, rows_per_piece):
    compare(spark, random_rows(chunk, 150, 14) + [(None, t, "user", f"no id {t}") for t in range(6)], chunk=chunk, rows_per_piece=rows_per_piece)


def test_one_long_conversation_over_many_pieces(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), f"{rng.randrange(300)}" + rng.choice(["", "."])) for t in range(1500)]
    rows += [(1, None, "user", "the same row.")] * 400 + [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(400)]
    rows += [(3, t, "tool", f"never kept {t}") for t in range(300)] + [(3, 1000, "user", "End."), (3, 1001, "assistant", "Yes.")]
    compare(spark, rows, rows_per_piece=60)


def test_nothing_and_next_to_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(empty).count() == 0
    compare(spark, [(5, None, None, None), (6, 1, "user", "Only one.")])


def test_costs_from_speculative_vectors():
    """Chunks of any size give the vectors of one plain pass, also where no chunk ever merges states."""
    rng = np.random.default_rng(6)
    for codes in (rng.integers(0, 9, 400), np.full(200, 7), np.concatenate([np.full(150, 8), rng.integers(0, 9, 50)]), np.zeros(0, int)):
        ends = np.array([len(codes) // 3, len(codes)]) if len(codes) else np.zeros(0, int)
        last = np.array([[0, 10, 5, 0], [7, 3, 9, 1]])[: len(ends)]
        plain = np.zeros((len(codes), 4), np.int64)
        for p, end in enumerate(ends):
            v = last[p]
            for i in range(end - 1, ends[p - 1] - 1 if p else -1, -1):
                plain[i] = v = (repair.STEPS[codes[i]] + v).min(axis=1)
        for chunk in (1, 2, 4, 7, 1000):
            here, after, passes = repair.backward_costs(codes, ends, last, chunk)
            assert (here == plain).all()
            inner = np.setdiff1d(np.arange(len(codes)), ends - 1)
            assert (after[inner] == plain[inner + 1]).all()
            assert passes <= 1 + len(codes)


def test_fix_up_passes_stop_at_convergence():
    """Kept turns merge all states, so two passes are enough however long the piece is."""
    codes = np.tile([1, 2], 5000)
    assert repair.backward_costs(codes, np.array([10000]), repair.END[None], 16)[2] <= 3


def test_the_rows_of_repaired_conversations(spark):
    rows = [(9, t, ("user", "user", "assistant")[t % 3], f"{t}.") for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, made = repair.repair(df)
    roles = [x.role for r in repair.repaired_turns(turns, made).orderBy("part", "pos").collect() for x in r.texts]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in roles))
    assert made.count() == turns.count()
