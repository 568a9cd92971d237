"""op2 against brute force on texts with ties, copies and odd rows, and on one large group of near copies."""

from __future__ import annotations

import random

from brookcheck.llm import near_dedup
from brookcheck.llm.graph import connected_components

SCHEMA = "doc_id long, text string, n long, v string, component long"


def brute(rows, size, percent):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], SCHEMA)
    return [tuple(r) for r in near_dedup.near_duplicates(df, **how).collect()]


def test_odd_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(9, base), (4, base.upper()), (7, base + " tail"), (1, None), (2, ""), (3, " \t\n"), (5, "one two"), (6, "ONE\vtwo"), (8, "one"), (10, "w " * 40000), (11, "a b c d e f"), (12, " ".join(reversed(base.split())))]
    assert sorted(run(spark, rows, shingle=3, percent=85)) == brute(rows, 3, 85)


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h"
    got = run(spark, [(None, text), (3, text), (3, text), (2, text + " i")], shingle=3, percent=80)
    assert sorted(got, key=str) == sorted([(None, 6, None, False), (3, 6, 2, False), (3, 6, 2, False), (2, 7, 2, True)], key=str)
    assert run(spark, []) == []


def test_rows_that_repeat_an_id_with_other_texts_keep_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, a), (3, b), (5, a + " tail"), (6, b + " tail")]
    assert sorted(r[:3] for r in run(spark, rows, shingle=3, percent=85)) == [(3, 38, 3), (3, 38, 3), (5, 39, 3), (6, 39, 3)]


def test_recall_of_pairs_at_the_threshold(spark):
    """1,200 pairs of which the sets share 85 to 87 in a hundred: at most one is lost."""
    r, rows = random.Random(9), []
    for i in range(1200):
        w = [f"p{i}_{k}" for k in range(122)]
        v = w[:]
        for k in r.sample(range(8, 114, 8), 3):
            v[k] = f"q{i}_{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = run(spark, rows, shingle=3, percent=85)
    # 120 shingles each, of which 9 differ: 111 / 129.
    assert sum(x[0] != x[2] for x in got) >= 1199


def test_large_group_of_near_copies(spark):
    """More than a leaf holds, near the threshold, beside unrelated texts that share a passage."""
    r = random.Random(1)
    base, hot = [f"w{r.randrange(9999)}" for _ in range(120)], [f"h{i}" for i in range(20)]
    rows = []
    for i in range(300):
        w = base[:]
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(99999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(hot + [f"u{i}_{k}" for k in range(60)])) for i in range(200)]
    got, want = sorted(run(spark, rows, shingle=3, percent=85)), brute(rows, 3, 85)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (None, 3), (61, 60), (3000, 2999)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(62)}, **{1000 + i: 1000 for i in range(80)}, 3000: 2999, 2999: 2999}


def test_sets_whose_fingerprints_agree_in_64_bits_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    whole = near_dedup.describe
    monkeypatch.setattr(near_dedup, "describe", lambda docs, shingle: whole(docs, shingle).withColumn("v", F.when(F.col("doc_id") < 4, 7).otherwise(F.col("v")).cast("long")))
    rows = [(1, "one text of some words"), (2, "quite another text with its own words"), (3, "one text of some words"), (4, "a third text that is alone here"), (5, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (3, 1), 2: (5, 2), 3: (3, 1), 4: (5, 4), 5: (0, 5)}
