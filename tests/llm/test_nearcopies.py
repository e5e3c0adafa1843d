import importlib

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import nearcopies


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts, and for each three copies with 1 to 14 edited words."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocabulary, 300))
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for at in rng.choice(300, 1 + (i + 4 * k) % 14, replace=False):
                copy[at] = f"edit{i}x{k}x{at}"
            rows.append((10 * i + k, " ".join(copy)))
    return rows


def components(rows):
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similarity(sets[i], sets[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    return [min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in group]


def test_groups_against_brute_force(spark):
    rows = [*planted(), (2000, None), (2001, " \n"), (2002, "one two"), (2003, "One  TWO"), (2004, "one two three")]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as bands")
    found = nearcopies.near_copies(df).collect()
    got = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert [r.component_id for r in found if r.doc_id is None] == [0]
    assert got == dict(zip([d for d, _ in rows], components(rows), strict=True))


def test_stage_drops_edited_copies_and_nothing_else(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in importlib.import_module("corpus_pipeline").near_dedup(spark, docs, "").collect()}
    assert kept == set(components(rows))
    sets = dict((d, shingles(t)) for d, t in rows)
    near = [d for d in sets if d % 10 and similarity(sets[d], sets[d - d % 10]) >= 0.8]
    assert len(near) > 60 and not kept & set(near)


def test_bands_over_the_block_size_stay_whole(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        copy = list(base)
        copy[int(rng.integers(200))] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows = nearcopies.keyed_rows(docs)
    prints = nearcopies.with_sets(rows, 5)
    links = nearcopies.similar_links(prints, rows, 5, 0.8, block=20)
    found = nearcopies.group_by_links(prints.select("doc_id", "fp"), links).collect()
    assert len(found) == 90 and {r.component_id for r in found} == {0}


def test_empty(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_keep(rows):
    """Rows that stay, as a list of (doc_id, text): of each group the smallest id, ids before null."""
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and similarity(sets[i], sets[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for g, (d, _) in zip(group, rows, strict=True):
        best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    return [(g, b) for g, b in best.items()], dict(enumerate(group))


def test_repeated_and_null_ids_lose_no_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    four = [(3, a), (5, a), (5, b), (7, b)]
    out = nearcopies.keep_one(spark.createDataFrame(four, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(3, a), (5, b)]
    rng = np.random.default_rng(11)
    texts = [t for _, t in planted()[:60]] + ["", None, " ", "short", "Short"]
    rows = [(None if rng.random() < 0.2 else int(rng.integers(25)), texts[int(rng.integers(len(texts)))]) for _ in range(260)]
    df = spark.createDataFrame([(d, t, "x" if i % 2 else None) for i, (d, t) in enumerate(rows)], "doc_id long, text string, k1 string").withColumnRenamed("k1", "row")
    got = nearcopies.keep_one(df).collect()
    best, group = brute_keep(rows)
    by_text = {t: g for (_, t), g in zip(rows, group.values(), strict=True)}
    assert sorted((by_text[r.text], (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(best)
    assert got[0].asDict().keys() == {"doc_id", "text", "row"}
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_simhash_groups_are_candidates(spark):
    """Without bands the links come from the SimHash search alone."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:200] + [f"edit{i}"] + base[200:])) for i in range(12)] + [(50, "other words entirely in this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = nearcopies.keyed_rows(df)
    prints = nearcopies.with_sets(keyed, 5).withColumn("bands", F.array().cast("array<long>"))
    links = nearcopies.similar_links(prints, keyed, 5, 0.8)
    found = nearcopies.group_by_links(prints.select("doc_id", "fp"), links).collect()
    assert len({r.component_id for r in found}) < 13
