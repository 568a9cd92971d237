"""Passages that repeat across documents, by a sparse suffix array over words.

Equal texts are one unit first.  Of each unit, suffixes are retained at the
positions of minimisers: the least hash of a run of ``k`` words among every
``w`` neighbouring runs, with ``k + w - 1`` the least length of a passage, so
that two occurrences of a passage always retain a suffix at the same place in
it, less than ``w`` words from its start.  Suffixes whose first run only one unit
holds are dropped.  The others are dealt out by that run, sorted by their words,
and each is compared with its ``NEAR`` neighbours on either side: what a pair
shares from the retained position on, and going back from it, is a match, and
one of the least length or more is a repeated passage.

Where more suffixes share a prefix than those, a passage may be one that none of the
neighbours shares to the left as well.  Only the runs of the least length
that the prefix shared beyond the neighbours leaves open are then looked
up, among all suffixes with such a prefix, so nothing is lost.  Longer passages are unions of matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, mix, tidy, word_hashes, _powers

#: Neighbours on either side that a suffix is compared with.
NEAR = 4
#: First runs that more suffixes have are dealt out further, by the words that follow and by text; all their open runs are looked up.
HOT = 20_000


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words; rows are texts if ``words`` has two dimensions."""
    up, down = _powers(words.shape[-1])
    total = np.zeros((*words.shape[:-1], words.shape[-1] + 1), np.uint64)
    np.cumsum(words * up[: words.shape[-1]], axis=-1, out=total[..., 1:], dtype=np.uint64)
    return mix((total[..., k:] - total[..., :-k]) * down[: words.shape[-1] - k + 1])


def minimisers(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the leftmost least run of every ``w`` neighbouring runs, its hash, and how far before it the first and the last passage start of which it is the least run."""
    if len(words) < k + w - 1:
        return (np.zeros(0, np.int64),) * 4
    h = _runs(words, k)
    least = np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1) + np.arange(len(h) - w + 1)
    at, first, n = np.unique(least, return_index=True, return_counts=True)
    return at, h[at].view(np.int64), at - first, at - first - n + 1


_MARKS = ("ps", "gs", "far", "near")


def _retain(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = word_hashes(text.encode(), lower=False)
                rows.append((len(words), *minimisers(words, k, w)))
            yield pdf[["doc_id", "th", "tl"]].assign(n_words=[r[0] for r in rows], **{c: [r[i] for r in rows] for i, c in enumerate(_MARKS, 1)})
    return run


def _suffixes(left: int, right: int):
    """Words around each retained position: ``right`` from it on, ``left`` before it, nearest first; and the shard it is sorted in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for th, tl, text, ps in zip(pdf["th"], pdf["tl"], pdf["text"], pdf["ps"], strict=True):
                words = (word_hashes(text.encode(), lower=False) >> np.uint64(32)).astype(">u4")
                padded = np.concatenate([np.zeros(left, ">u4"), words, np.zeros(right, ">u4")])
                p, g, salts = (np.array([x[c] for x in ps], np.int64) for c in ("p", "g", "salts"))
                around = padded[p[:, None] + np.arange(left + right)]
                after = _runs(mix(around[:, left:].astype(np.uint64)), right)[:, 0]
                part = np.uint64(th % (1 << 62)) % np.maximum(salts, 1).astype(np.uint64)
                shard = np.where(salts > 0, mix(g.view(np.uint64) ^ mix(after + part)), g.view(np.uint64)).view(np.int64)
                yield pd.DataFrame({"th": th, "tl": tl, "shard": shard, "hot": salts > 0, "p": p, "far": [x["far"] for x in ps], "near": [x["near"] for x in ps], "n": np.minimum(right, len(words) - p), "suffix": [r.tobytes() for r in around[:, left:]], "before": [r.tobytes() for r in around[:, left - 1::-1]]})
    return run


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words rows agree in before they first differ."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


class _Sorted:
    """Suffixes in order; ``matches`` compares those from ``lo`` to ``hi`` with their neighbours."""

    def __init__(self, pdf: pd.DataFrame, left: int, right: int):
        self.pdf = pdf
        self.s = np.frombuffer(b"".join(pdf["suffix"]), ">u4").reshape(-1, right)
        self.b = np.frombuffer(b"".join(pdf["before"]), ">u4").reshape(-1, left)
        self.th, self.shard, self.p, self.n, self.far, self.near = (pdf[c].to_numpy(np.int64) for c in ("th", "shard", "p", "n", "far", "near"))
        self.hot = pdf["hot"].to_numpy(bool)

    def matches(self, lo: int, hi: int, least: int) -> pd.DataFrame:
        """th, tl, a, e, run, kind: 0 a repeated passage, 1 a run of ``least`` words to look up, 2 one known to be repeated."""
        size, left = len(self.s), self.b.shape[1]
        beyond, pairs = np.where(self.hot, self.s.shape[1], 0), []
        for d in range(1, NEAR + 2):
            x = np.arange(max(0, lo - d), min(hi, size - d))
            x = x[self.shard[x] == self.shard[x + d]]
            y = x + d
            if not len(x):
                continue
            r = np.minimum(_shared(self.s[x], self.s[y]), np.minimum(self.n[x], self.n[y]))
            if d > NEAR:
                np.maximum.at(beyond, x, r)
                np.maximum.at(beyond, y, r)
                continue
            back = np.minimum(_shared(self.b[x], self.b[y]), np.minimum(self.p[x], self.p[y]))
            ok = (self.th[x] != self.th[y]) & (back + r >= least)
            pairs += [np.stack([z[ok], back[ok], r[ok]]) for z in (x, y)]
        found = np.unique(np.concatenate([np.zeros((3, 0), np.int64), *pairs], axis=1), axis=1)
        found = found[:, (found[0] >= lo) & (found[0] < hi)]
        at, back, r = found
        out = [self._rows(at, self.p[at] - back, self.p[at] + r, 0, 0)]
        # A level is the number of words a run starts before the retained position.
        wide = lo + np.flatnonzero((beyond[lo:hi] >= least - self.far[lo:hi]) & (beyond[lo:hi] > 0))
        if len(wide):
            level = np.arange(left + 1)
            open_ = (level >= self.near[wide, None]) & (level <= self.far[wide, None]) & (least - level <= beyond[wide, None])
            known = np.zeros_like(open_)
            row = np.searchsorted(wide, at)
            held = (row < len(wide)) & (wide[np.minimum(row, len(wide) - 1)] == at)
            np.logical_or.at(known, row[held], (level <= back[held, None]) & (least - level <= r[held, None]))
            h = _runs(mix(np.concatenate([self.b[wide][:, ::-1], self.s[wide]], axis=1).astype(np.uint64)), least)[:, left - level]
            i, j = np.nonzero(open_)
            a = self.p[wide[i]] - level[j]
            out.append(self._rows(wide[i], a, a + least, h[i, j].view(np.int64), np.where(known[i, j], 2, 1)))
        return pd.concat(out, ignore_index=True)

    def _rows(self, at, a, e, run, kind) -> pd.DataFrame:
        return pd.DataFrame({"th": self.th[at], "tl": self.pdf["tl"].to_numpy(np.int64)[at], "a": a, "e": e, "run": run, "kind": kind})


def _compare(left: int, right: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done, keep_ = None, 0, NEAR + 1
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                before = max(0, done - keep_)
                pdf, done = pd.concat([held.iloc[before:], pdf], ignore_index=True), done - before
            held = pdf
            upto = max(done, len(pdf) - keep_)
            yield _Sorted(pdf, left, right).matches(done, upto, least)
            done = upto
        if held is not None:
            yield _Sorted(held, left, right).matches(done, len(held), least)
    return run


@tidy
def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_words, repeated_words, n_spans, spans: documents that hold a passage of ``least`` words or more that other documents hold too.

    Words are compared as they stand; spans are ``start:end`` in words, end
    exclusive, in order, comma-joined, none touching another.  All of a text
    that several rows share is repeated.  A passage that only one text holds,
    however often, is not.  Null, empty and shorter texts hold none and are
    left out, as are all documents without one; a row without doc_id counts
    like any other.  Texts are told apart by 128 bits of hash.  Further columns are ignored; an empty table gives none.
    """
    k = least * 2 // 5
    w = least - k + 1
    left, right = w - 1, least
    text = [F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tl")]
    unit = ["th", "tl"]
    rows = docs.where("text is not null").select(F.col("doc_id").cast("string"), "text", *text)
    rows = keep(rows.mapInPandas(_retain(k, w), "doc_id string, th long, tl long, n_words long, ps array<long>, gs array<long>, far array<long>, near array<long>"), "retained")
    units = rows.groupBy(*unit).agg(F.count("*").alias("rows"), F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in _MARKS])
    units = keep(units.where(F.col("n_words") >= least), "units")
    marks = units.select(*unit, F.inline(F.arrays_zip(*[F.col(c) for c in _MARKS]))).toDF(*unit, "p", "g", "far", "near")
    often = marks.groupBy("g").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    often = keep(often.select("g", F.when(F.col("n") > HOT, F.ceil(F.col("n") / HOT)).otherwise(0).alias("salts")), "often")
    at = marks.join(often, "g").groupBy(*unit).agg(F.collect_list(F.struct("p", "g", "far", "near", "salts")).alias("ps"))
    texts = docs.where("text is not null").select(*text, "text").join(at, unit).dropDuplicates(unit)
    suffixes = texts.select(*unit, "text", "ps").mapInPandas(_suffixes(left, right), "th long, tl long, shard long, hot boolean, p long, far long, near long, n long, suffix binary, before binary")
    compared = suffixes.repartition("shard").sortWithinPartitions("shard", "suffix", "before", "th", "p").mapInPandas(_compare(left, right, least), "th long, tl long, a long, e long, run long, kind int")
    compared = keep(compared, "compared")
    # Written, so that the join reads two plain exchanges, which adaptive execution splits where a run is very common.
    shared = compared.where("kind > 0").groupBy("run").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.min("kind").alias("kind")).where("lo <> hi and kind = 1")
    shared = keep(shared.select("run"), "shared")
    spans = compared.where("kind = 0").select(*unit, "a", "e").unionByName(compared.where("kind = 1").join(shared, "run").select(*unit, "a", "e"))
    # Spans in order; one that a former reaches goes on with it.
    in_order = W.partitionBy(*unit).orderBy("a")
    spans = spans.withColumn("new", F.when(F.max("e").over(in_order.rowsBetween(W.unboundedPreceding, -1)) >= F.col("a"), 0).otherwise(1))
    spans = spans.withColumn("k", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*unit, "k").agg(F.min("a").alias("a"), F.max("e").alias("b"))
    found = spans.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))
    found = units.select(*unit, "rows", "n_words").join(found, unit, "left").select(*unit, F.when(F.col("rows") > 1, whole).otherwise(F.col("spans")).alias("spans")).where("spans is not null")
    found = keep(found, "spans")
    written = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["a"], x["b"])), ",")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda o, x: o + x["b"] - x["a"])
    ids = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return rows.select("doc_id", *unit, "n_words").join(found, unit).select(ids, "n_words", total.alias("repeated_words"), F.size("spans").cast("long").alias("n_spans"), written.alias("spans"))


def sql(least: int = 50) -> str:
    return rf"""
WITH t AS (SELECT text, count(*) AS n_rows, any_value(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS ws FROM documents WHERE text IS NOT NULL GROUP BY text),
u AS (SELECT row_number() OVER () AS u, text, n_rows, ws, len(ws) AS n_words FROM t WHERE len(ws) >= {least}),
r AS (SELECT u, s, md5(array_to_string(ws[s + 1:s + {least}], ' ')) AS run FROM (SELECT u, ws, unnest(range(0, n_words - {least - 1})) AS s FROM u)),
shared AS (SELECT run FROM r GROUP BY run HAVING min(u) <> max(u)),
st AS (SELECT u, s FROM r JOIN shared USING (run)),
isl AS (SELECT u, s, sum(new) OVER (PARTITION BY u ORDER BY s) AS k FROM (SELECT u, s, CASE WHEN s <= lag(s) OVER (PARTITION BY u ORDER BY s) + {least} THEN 0 ELSE 1 END AS new FROM st)),
sp AS (SELECT u, min(s) AS a, max(s) + {least} AS b FROM isl GROUP BY u, k),
f AS (SELECT u, a, b FROM sp JOIN u USING (u) WHERE n_rows = 1 UNION ALL SELECT u, 0, n_words FROM u WHERE n_rows > 1),
g AS (SELECT u, CAST(sum(b - a) AS BIGINT) AS repeated_words, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM f GROUP BY u)
SELECT d.doc_id, CAST(u.n_words AS BIGINT) AS n_words, g.repeated_words, CAST(g.n_spans AS BIGINT) AS n_spans, g.spans FROM documents d JOIN u ON u.text = d.text JOIN g ON g.u = u.u"""
