"""op11 against a scan of all periods, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np

from brookcheck.llm import periodic


def brute(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def made(rng):
    """Words with runs of all kinds: nested, neighbouring, of words that are common elsewhere."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abcdefgh"[:rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 14))]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 90)]
        out += [rng.choice("abxyz") + str(rng.randrange(rng.choice((1, 3, 900)))) for _ in range(rng.randrange(0, 12))]
    return out


def test_runs_of_made_texts_equal_all_periods():
    rng = random.Random(11)
    for _ in range(400):
        words = made(rng)
        assert periodic.runs_of(periodic.word_ids([w.encode() for w in words])) == brute(words)
        assert periodic.runs_of(periodic.word_ids([w.encode() for w in words]), 6, 4) == brute(words, 6, 4)


def test_words_with_regular_structure():
    """Fibonacci and Thue-Morse words, on which sums of powers collide, a whole text of one word, and runs in runs."""
    fib, morse = ["a", "ab"], [0]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    while len(morse) < 4096:
        morse += [1 - x for x in morse]
    inner = list("ab" * 20 + "c")
    for words in (list(fib[-1]), [str(x) for x in morse], ["x"] * 500, inner * 7, [str(x) for x in morse[:1024]] * 4):
        assert periodic.runs_of(periodic.word_ids([w.encode() for w in words])) == brute(words)


def test_frequency_splits_until_nothing_changes():
    """r splits the text; then s is too rare in both parts and splits them again, which leaves only the run."""
    text = ("s " + "f1 f2 " * 3 + "r " + "s f1 " * 2 + "a b c " * 10).split() + ["t"]
    ids = periodic.word_ids([w.encode() for w in text])
    start = text.index("a")
    assert periodic.segments(ids, 24, 3) == [(start, start + 30)]
    assert periodic.runs_of(ids) == [(start, 30, 3)]
    assert periodic.segments(np.arange(1000), 24, 3) == []


def test_long_texts_take_seconds():
    rng = np.random.default_rng(3)
    began = time.time()
    assert periodic.runs_of(np.tile(np.arange(100_000), 3)) == [(0, 300_000, 100_000)]
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(rng.integers(0, 50, 200_000)) == []
    assert time.time() - began < 60


def test_rows_of_the_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.spliced(docs))).collect())
    want = sorted(row(*r) for r in rows)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    spaced = "\x0b a b  c d \r\n" * 30  # only six characters part words
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    # 39 has h % 10 = 0
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, "x " * 40), (7, "x " * 40), (7, "x " * 40), (8, None), (9, ""), (1, spaced), (2, long), (tenth, None), (tenth, " "), (tenth, "one"), (tenth, " ".join(f"v{i}" for i in range(200)))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = sorted((tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.spliced(df))).collect()), key=str)
    short = [r for r in rows if r[1] is not long]
    want = [row(*r) for r in short]
    kept = hashlib.sha256(" ".join(f"w{i}" for i in range(5000)).encode()).hexdigest()
    want.append((2, 1, 0, 60_000, 5000, 12_000, hashlib.sha256(b"0,60000,5000\n").hexdigest(), kept))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_exponents_are_compared_exactly(spark):
    """(3m + 1) / m with m near 2^27: doubles cannot tell the two apart."""
    m = 134_217_729
    df = spark.createDataFrame([(1, "", [(0, 3 * m + 1, m), (5, 3 * (m - 1) + 1, m - 1)])], f"doc_id long, collapsed string, runs {periodic.RUNS}")
    r = periodic.digest(df).first()
    assert (r.start, r.period, r.exponent_milli) == (5, m - 1, 3000)
