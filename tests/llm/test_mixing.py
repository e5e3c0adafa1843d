import random
import re
from collections import defaultdict

import pytest

from docmill.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        all_weights, more = sum(weight[s] for s in free), 0.0
        for s in list(free):
            out[s] += left * weight[s] / all_weights
            if out[s] >= most * sizes[s]:
                more += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                free.discard(s)
        left = more
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, " ".join(["w"] * int(2 ** (rng.random() * 9))), f"src{rng.randrange(4)}" if i % 3 else "hot", "x") for i in range(1500)]
    out += [(None, "no id\tat all\x0bof", None, "x")] * 5 + [(7, None, "src0", "x"), (8, "", "src1", "x"), (9, " \n  ", "é", "x"), (9, "word " * 20000, "\U0001f600", "x")]
    return out + [(5, "a repeated row", "hot", "x")] * 5000


@pytest.fixture(scope="module")
def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").selectExpr("*", "1 as size", "'k' as key", "2L as copies")
    return df, [r.asDict() for r in mixing.mix_sources(df).collect()]


def test_whole_sizes_and_targets(rows, mixed):
    got = mixed[1]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["source"] or "", r["size"]) for r in got) == sorted((r[0] or -1, r[2] or "", size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)


def test_taken_words_meet_the_targets(rows, mixed):
    taken, target, smallest = defaultdict(int), {}, defaultdict(lambda: 1 << 60)
    for r in mixed[1]:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in ("hot", "src0", "src1", "src2", "src3"):
        assert abs(taken[s] - target[s]) <= 4, (s, taken[s], target[s])  # the last open document is among the smallest
    for s in target:
        assert abs(taken[s] - target[s]) <= 20000


def test_reruns_agree_whatever_the_partitions(spark, rows, mixed):
    df = mixed[0].repartition(7, "text")
    again = mixing.mix_sources(df).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["text_key"], r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, mixed[1]))


def test_the_fold_against_a_plain_loop(spark):
    rng = random.Random(5)
    items = [(rng.getrandbits(40), i, 0, s := rng.randrange(1, 50), 0, s * rng.random()) for i in range(40)]
    df = spark.createDataFrame([(items,)], f"items array<{mixing.ITEM}>")
    from pyspark.sql import functions as F

    fold = df.select(mixing._folded(F.col("items"), F.lit("d")).alias("f")).first().f
    pairs = spark.createDataFrame([(a[0], b[0]) for a in items for b in items], "a long, b long").selectExpr("a", "b", "pmod(xxhash64('d', a, b), 1L << 40) / double(1L << 40) u").collect()
    u = {(r.a, r.b): r.u for r in pairs}
    kept, decided = list(items[0]), {}
    for new in map(list, items[1:]):
        up, down = min(kept[3] - kept[5], new[5]), min(kept[5], new[3] - new[5])
        moved = up if u[kept[0], new[0]] * (up + down) < down else -down
        kept_ends = up == kept[3] - kept[5] if moved > 0 else down == kept[5]
        kept[5], new[5] = kept[5] + moved, new[5] - moved
        if kept_ends:
            kept, new = new, kept
        decided[new[1]] = round(new[5])
    assert {r.doc_id: r.mass for r in fold.decided} == decided
    assert (fold.kept.doc_id, fold.kept.mass) == (kept[1], pytest.approx(kept[5]))
    assert sum(r.mass for r in fold.decided) + fold.kept.mass == pytest.approx(sum(i[5] for i in items))


def test_means_are_kept(spark):
    """Over many draws each document is taken as often as its mean says."""
    from pyspark.sql import functions as F

    items = [(i + 1, i, 0, s, 0, s * p) for i, (s, p) in enumerate([(3, 0.2), (10, 0.5), (1, 0.9), (7, 0.35), (2, 0.7)])]
    n = 4000
    df = spark.range(n).select(F.lit(None).cast(f"array<{mixing.ITEM}>").alias("x"), "id").crossJoin(spark.createDataFrame([(items,)], f"items array<{mixing.ITEM}>"))
    fold = df.select(mixing._folded(F.col("items"), F.col("id").cast("string")).alias("f"))
    sums = fold.select(F.explode(F.concat("f.decided", F.array("f.kept"))).alias("i")).groupBy("i.doc_id").agg(F.avg(F.col("i.mass") / F.col("i.size")).alias("p"))
    for r in sums.collect():
        size, mass = items[r.doc_id][3], items[r.doc_id][5]
        assert abs(r.p - mass / size) < 0.03


def test_the_mix_itself(spark, mixed):
    df, plan = mixed
    out = mixing.take(df, spark.createDataFrame([(r["doc_id"], r["source"], r["text_key"], r["copies"]) for r in plan], "doc_id long, source string, text_key long, copies long"))
    assert out.count() == sum(r["copies"] for r in plan)
    assert out.where("doc_id = 5 and source = 'hot' and text = 'a repeated row'").count() == sum(r["copies"] for r in plan if r["doc_id"] == 5 and r["size"] == 3 and r["source"] == "hot")


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    only = mixing.mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in only] == [(1, 0, 0.0, 0)]
