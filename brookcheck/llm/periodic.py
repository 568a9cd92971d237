"""Periodic runs of words, by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical), as long as ``least`` words and ``times`` periods, that no
neighbouring word extends keeping the period.  Each of its words occurs ``times``
times or more inside it.  So a word that a segment holds less often is in none of its
runs: it splits the segment, and the parts, in which further words may have become
too rare, are split again until nothing changes.  Parts shorter than ``least`` go.

What survives is scanned lag by lag.  A run of period ``q`` is ``times`` periods long, so one of the
blocks of ``q`` words that start at a multiple of ``q`` equals the next block: all
blocks of a lag are compared at once by hash, which over all lags of ``n``
words takes ``n log n`` comparisons.  Only where two blocks agree are the words around them compared
themselves.  A place inside a run of smaller period is skipped, as what is periodic there has that period throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, mix, _powers

#: Rounds of splitting; segments of a text that still changes then are scanned as they are, with the same runs.
ROUNDS = 200
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    """The same number for the same word."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def segments(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text whose words all occur often enough for a run to hold them."""
    at, out = np.arange(len(ids)), []
    part = np.zeros(len(ids), np.int64)
    for step in range(ROUNDS + 1):
        if len(at) < least:
            return out
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(part) != 0), [True]]))
        size = np.diff(edge)
        part = np.repeat(np.arange(len(size)), size)
        key = part * (int(ids.max()) + 1) + ids[at]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        rare = n[back] < times
        whole = np.bincount(part, rare, len(size)) == 0
        if step == ROUNDS:
            whole[:] = True
        for i in np.flatnonzero(whole & (size >= least)):
            out.append((int(at[edge[i]]), int(at[edge[i]] + size[i])))
        stays = ~rare & ~whole[part] & (size >= least)[part]
        at, part = at[stays], part[stays]
    return out


def scan(x: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    n, out = len(x), []
    up, _ = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64)) * up[:n], out=total[1:], dtype=np.uint64)
    reach = np.zeros(n, np.int64)  # the furthest end of a run found that holds a word
    for q in range(1, n // times + 1):
        d = np.diff(total[::q])
        k = np.flatnonzero(d[1:] == d[:-1] * up[q])
        if not len(k):
            continue
        new = np.concatenate([[True], np.diff(k) > 1])
        for a, b in zip(k[new], k[np.concatenate([new[1:], [True]])], strict=True):
            a, b = int(a) * q, int(b + 2) * q
            if reach[a] >= b:
                continue
            lo, hi = max(0, a - q), min(n - q, b)
            same = np.concatenate([[False], x[lo:hi] == x[lo + q:hi + q], [False]])
            edge = np.flatnonzero(np.diff(same.view(np.int8)))
            for s, e in zip(edge[::2] + lo, edge[1::2] + lo + q, strict=True):
                if e - s >= max(least, times * q) and reach[s] < e:
                    out.append((int(s), int(e - s), q))
                    np.maximum(reach[s:e], e, out=reach[s:e])
    return out


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    return sorted((s + start, length, q) for start, end in segments(ids, least, times) for s, length, q in scan(ids[start:end], least, times))


def _find(least: int, times: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, found, kept = [], [], []
            for text in pdf["text"]:
                words = text.encode().split()  # bytes are split at space, \t, \n, \v, \f and \r alone
                ids = word_ids(words)
                runs = runs_of(ids, least, times)
                repeats = np.zeros(len(words), bool)
                for s, length, q in runs:
                    repeats[s + q:s + length] = True
                sizes.append(len(words))
                found.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                kept.append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(~repeats)]).decode())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": sizes, "runs": found, "collapsed": kept})
    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text in which each run keeps its first period.

    Words are compared as they stand; ``collapsed`` joins them by one space.  A row for each row of ``docs``, also for those that repeat or
    have no doc_id.  Null and empty texts have no words and an empty ``collapsed``.  Further columns are ignored; an empty
    table stays empty.  Each text is judged by itself: nothing is shuffled, and a task holds one batch of texts.
    ``times`` is 3 or more: of two periods alone, no two neighbouring blocks need agree.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(_find(least, times), f"doc_id string, n_words long, runs {RUNS}, collapsed string")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "runs", "collapsed")


def spliced(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten, told by h = crc32(doc_id), has become periodic from a word on.

    With g = floor(h / 10), h divisible by ten and n > 0 words, each word i >= a is word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  Other texts, and those without doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("ws"))
    at = words.select("doc_id", "text", "ws", F.expr("h div 10").alias("g"), F.size("ws").cast("long").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    at = at.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    int_ = lambda c: c.cast("int")
    head = F.slice("ws", F.lit(1), int_(F.col("a")))
    unit = F.slice("ws", int_(F.col("a") + 1), int_(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(unit, int_(F.lit(4) + F.col("g") % 8))), F.lit(1), int_(F.col("n") - F.col("a")))
    return at.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exponent (exactly; ties: smallest start, then period) and digests of the runs and of what is kept."""
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # Runs come by start, then period, so the first of equals stays.
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda top, x: F.when(ahead(x, top), x).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent, "runs_sha256", "collapsed_sha256")


def sql() -> str:
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
    return rf"""
WITH t AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {crc} AS h FROM documents),
p AS (SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM t),
o AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS w0, ws, a, 1 + (n - a) // (3 + g % 8) AS p FROM p),
w AS MATERIALIZED (SELECT doc_id, n, i, CASE WHEN i >= a THEN ws[1 + a + (i - a) % p] ELSE w0 END AS w FROM o),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(24, 3 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS rk FROM r) WHERE rk = 1),
d AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""
