import numpy as np
import xxhash

from docmill.llm import simhash

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(rows, words=3, distance=3):
    prints = []
    for _, text in rows:
        w = [p for p in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).replace(b"\x0b", b" ").split() if p]
        sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                group[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.setdefault((rows[i][0], format(prints[i], "016x"), min(ids) if ids else None), 0)
        out[rows[i][0], format(prints[i], "016x"), min(ids) if ids else None] += 1
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "one  two"), (7, BASE), (8, BASE.upper()), (None, BASE), (9, BASE), (9, BASE), (10, "é É ü")]
    for i in range(120):
        text = list(rng.choice(words, 300))
        rows.append((100 + 10 * i, " ".join(text)))
        for k in range(i % 4):
            text[int(rng.integers(300))] = "edit"
            rows.append((101 + 10 * i + k, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id", "2 as slot")
    found = simhash.near_duplicates(df).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') f", "component_id").collect()
    got = {}
    for r in found:
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == brute(rows)


def test_links_of_a_crowded_key_are_whole(spark):
    """Fingerprints in one small ball: keys far over the block size, every link kept."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base}
    for _ in range(700):
        x = base
        for b in rng.choice(40, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                group[root(f)] = root(g)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, block=64)
    from docmill.llm.components import connected_components

    label = {r.node: r.component for r in connected_components(links).collect()}
    lowest = {}
    for f in fps:
        lowest[root(f)] = min(f, lowest.get(root(f), f))
    assert all(label.get(f, f) == lowest[root(f)] for f in fps)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
