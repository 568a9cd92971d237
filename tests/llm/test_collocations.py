"""op12 against plain counting in Python, with and without candidates in the tasks, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from brookcheck.llm import collocations as co

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, longest=3, support=10, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        rank = []
        for p, a in many.items():
            if any(p == q[i:i + len(p)] and 100 * b >= inside * a for q, b in many.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def texts(rng, n, words):
    return [("".join(rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", "\n", ", ", "!"]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["New", "york", "CITY", "of", "the", "é", "É", "\x1f", " ", "the-end", "a", "b"] + [f"w{i}" for i in range(30)]
    made = [(t, rng.choice(["en", "en", "en", "de", None, "und"])) for t in texts(rng, 300, words)]
    made += [("The New York city, the new\x0byork CITY", "en")] * 40
    return made + [(None, "en"), ("", None), (" \t\n.,", "xx"), ("word " * 5000, "fr"), ("unbroken" * 3000, "fr")]


def frame(spark, rows):
    # Extra columns clash with those of the result and with names used inside.
    return spark.createDataFrame([(i if i % 7 else None, t, lang, 1, "x", 2) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string, h int")


@pytest.mark.parametrize("shards", [1, 4, 25])
def test_counts_equal_plain_ones(spark, rows, shards):
    assert sorted(map(tuple, co.collocations(frame(spark, rows), shards=shards).collect())) == brute(rows)


def test_a_filter_that_lets_nearly_all_through(spark, rows, monkeypatch):
    """The functions travel whole, and with them what they read of the module."""
    monkeypatch.setattr(co, "BITS", 11)
    monkeypatch.setattr(co, "HELD", 10)
    assert sorted(map(tuple, co.collocations(frame(spark, rows)).collect())) == brute(rows)


def test_longer_phrases_and_few_ranks(spark, rows):
    got = sorted(map(tuple, co.collocations(frame(spark, rows), longest=4, support=6, inside=70, top=5).collect()))
    assert got == brute(rows, 4, 6, 70, 5)


def test_hashes_that_collide_add_candidates_only():
    """Words of one hash are candidates together; the exact count tells them apart."""
    words = co.Words([b"aa bb aa bb"], np.array([0]), np.array([1], np.uint64))
    words.word[:] = 5
    at, h = words.phrases(2)
    assert len(set(h.tolist())) == 1
    at, h, _, n = words.counted(at, h, 2)
    assert dict(zip(words.written(at, 2), n.tolist())) == {b"aa bb": 2, b"bb aa": 1}


def test_shards_are_mined_at_a_lowered_support(spark):
    """Nine occurrences in all are frequent in a shard by themselves, and not in the end."""
    rows = [(i, f"red wine {i}", "en") for i in range(9)] + [(i, f"red wine {i} blue sea", "en") for i in range(10, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    exact, n = co.frequent_phrases(docs, 2, 10, 4)
    assert {(r.phrase, r.a) for r in exact.collect()} == {("red", 12), ("wine", 12), ("red wine", 12)}
    assert [tuple(r) for r in n.collect()] == [("en", 9 * 3 + 3 * 5)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(10**14 + 7, 10**15 - 1, 10**14 + 9), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (3, 10**14, 7), (10**9 + 7, 10**9 + 9, 10**9 + 21)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    assert [x[0] for x in df.select(co.score("a", "l", "r")).collect()] == [1_000_000 * a * a // (l * r) for a, l, r in big]  # noqa: E741


def test_empty_table(spark, rows):
    assert co.collocations(frame(spark, rows).limit(0)).count() == 0
