"""Collocations of each language, from phrases mined by SON partitioning.

Documents are dealt to ``shards`` shards by hash.  A phrase that ``support``
occurrences make frequent in a language has, in one shard at least, as great a
share of them as the shard has of the language's words; so each shard is mined completely
at that lowered support (rounded up), and the union of what is frequent in some shard misses
nothing.  A shard in which a phrase is not frequent holds one occurrence less than its support at
most, so a candidate that cannot come to ``support`` even then goes at once.  A shard is mined length by length: a phrase can be frequent only if both of its
parts that are one word shorter are, so only such phrases are counted.  Phrases are known by 48-bit
hashes there.  Two that collide are counted together, which can only add a candidate.

Then all candidates of all lengths are counted over the whole corpus, by 96 bits of hash in a task and as written where tasks meet, and those below the
support go.

Counts are summed over each batch of texts and shuffled as packed arrays, a row for each language, shard and
range of hashes; the number of ranges grows with the bytes of text, so a group that is summed
holds the counts of a few megabytes of it.  What is known of candidates goes to the tasks as a filter of ``2 ** BITS`` bits, whatever their number:
a bit is set where a candidate's hash begins with its place.  It lets all candidates through, and the more others, the more
candidates there are; these are counted for nothing, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, mix, tidy, _LOWER, _powers

#: Binary logarithm of the bits of a filter (8 MB), and of the parts in which it is made.
BITS, MADE_IN = 26, 8
#: Counts that a task holds before it sums them, and hands them on if two thirds are left.
HELD = 1_500_000
#: Bytes of text that are counted at a time; a longer text goes alone.
CHUNK = 1 << 19
#: Bytes of text for each range of hashes of a shard.
RANGE = 4 << 20
#: The bits of a hash by which phrases are mined.
MINED = np.uint64(2**64 - 2**16)
#: Parts in which the phrases of a language are ranked before they meet.
PARTS = 64

_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(b".,;:!?\n\v\f\r")] = True
_GAP[list(b" \t")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_OTHER = mix(_LOWER) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of texts that are joined by line feeds: where each starts and ends, its piece, its text, its hash in its language."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, seeds: np.ndarray):
        self.data = _FOLD[np.frombuffer(b"\n".join(texts), np.uint8)]
        word = np.zeros(len(self.data) + 2, np.int8)
        cut = _CUT[self.data]
        word[1:-1] = ~(cut | _GAP[self.data])
        edge = np.flatnonzero(np.diff(word))
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.concatenate([[0], np.cumsum(cut)])[self.start]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.seed = seeds[langs[self.text]]
        self.word = self._hashes(_LOWER)

    def _hashes(self, of_byte: np.ndarray) -> np.ndarray:
        up, down = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(of_byte[self.data] * up[:len(self.data)], out=total[1:], dtype=np.uint64)
        return mix(mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64)) ^ self.seed)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all phrases of ``size`` words that lie in one piece."""
        n = max(0, len(self.word) - size + 1)
        at = np.flatnonzero(self.piece[:n] == self.piece[size - 1:size - 1 + n])
        return at, self._joined(self.word, at, size)

    @staticmethod
    def _joined(word: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = mix((h + word[at + k]) * _STEP)
        return h

    def counted(self, at: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first words, hashes, more bits of hash, counts) of the different phrases among these, told apart by 96 bits."""
        if not hasattr(self, "other"):
            self.other = self._hashes(_OTHER)
        more = (self._joined(self.other, at, size) >> np.uint64(32)).astype(np.uint32)
        first, n = _summed(h, np.ones(len(h), np.int64), more)
        return at[first], h[first], more[first], n

    def written(self, at: np.ndarray, size: int) -> list[bytes]:
        data = self.data.tobytes()
        words = [[data[a:b] for a, b in zip(self.start[at + k].tolist(), self.end[at + k].tolist(), strict=True)] for k in range(size)]
        return words[0] if size == 1 else [b" ".join(x) for x in zip(*words, strict=True)]

    def light(self) -> Words:
        """With no more than ``written`` needs."""
        self.start, self.end = self.start.astype(np.int32), self.end.astype(np.int32)
        del self.piece, self.text, self.seed, self.word, self.other
        return self


def _held(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` the filter lets through."""
    at = h >> np.uint64(64 - BITS)
    return (known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _bits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of a filter."""
    at = (pdf["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64) & ((1 << BITS - MADE_IN) - 1)
    bits = np.zeros(1 << BITS - MADE_IN, bool)
    bits[at] = True
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _filter(spark, tables: list[DataFrame]):
    """The filter of the hashes of all tables, given to the tasks; its size is fixed."""
    known = np.zeros(1 << BITS - 3, np.uint8)
    size = len(known) >> MADE_IN
    for x in tables:
        parts = x.select("h", F.shiftrightunsigned("h", 64 - MADE_IN).alias("part")).groupBy("part").applyInPandas(_bits, "part long, bits binary")
        for r in parts.toLocalIterator():
            known[r.part * size:(r.part + 1) * size] |= np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(known)


def _seed(lang: str) -> np.uint64:
    total = 0
    for b in lang.encode():
        total = (total * 1_000_003 + b + 1) % 2**64
    return mix(np.array([total], np.uint64))[0]


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], int, Words | None, np.ndarray]]:
    """(languages, shard, words, language of each text) of half a megabyte of text of one shard at a time; without words at the end of a shard's share of a batch."""
    langs, number = [], {}
    for pdf in batches:
        for x in sorted(set(pdf["lang"]) - set(number)):
            number[x] = len(langs)
            langs.append(x)
        seeds = np.array([_seed(x) for x in langs], np.uint64)
        text, lang, shards = pdf["text"], pdf["lang"].tolist(), pdf["shard"].to_numpy()
        for shard in np.unique(shards).tolist():
            texts, of, size = [], [], 0
            for i in np.flatnonzero(shards == shard).tolist():
                data = text.iat[i].encode()
                if texts and size + len(data) > CHUNK:
                    yield langs, shard, Words(texts, np.array(of), seeds), np.array(of)
                    texts, of, size = [], [], 0
                texts.append(data)
                of.append(number[lang[i]])
                size += len(data) + 1
            yield langs, shard, Words(texts, np.array(of), seeds), np.array(of)
            yield langs, shard, None, np.zeros(0, np.int64)


def _summed(h: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each different (h, more), sum of n)."""
    if not len(h):
        return np.zeros(0, np.int64), n
    order = np.lexsort((*more, h)) if more else np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = np.logical_or.reduce([np.diff(x[order]) != 0 for x in (h, *more)])
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(n[order], first)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers of 8 bytes, all first bytes first: bytes that are mostly zero then take next to nothing in a shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _steps(h: np.ndarray) -> bytes:
    """Sorted hashes as what each adds to the one before."""
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _hashes_of(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def _packed(langs: list[str], of: np.ndarray, h: np.ndarray, ranges: int, columns: dict[str, np.ndarray], shard: int) -> pd.DataFrame:
    """A row for each language and range of hashes, with the bytes of all columns and the sum of ``n``; ``h``, if it is a column, is sorted."""
    range_ = ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.lexsort((range_, of))
    of, range_, columns = of[order], range_[order], {k: x[order] for k, x in columns.items()}
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(range_) != 0), [True]]))
    out = {"lang": [langs[i] for i in of[edge[:-1]]], "shard": shard, "range": range_[edge[:-1]].astype(np.int64), "total": np.add.reduceat(columns["n"], edge[:-1])}
    for k, x in columns.items():
        join = (lambda y: b"\n".join(y.tolist())) if x.dtype == object else _steps if k == "h" else _planes
        out[k] = [join(x[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return pd.DataFrame(out)


def _mine(size: int, parts, ranges: int):
    """Counts of phrases of ``size`` words by shard; with ``parts``, only of those whose parts of one word less it lets through."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = parts.value if parts is not None else None, []
        for langs, shard, words, of in _chunks(batches):
            if words is None:
                if held:
                    h, n, lang = (np.concatenate(x) for x in zip(*held, strict=True))
                    first, n = _summed(h, n)
                    yield _packed(langs, lang[first], h[first], ranges, {"h": h[first], "n": n}, shard)
                held = []
                continue
            at, h = words.phrases(size)
            if known is not None:
                ok = np.zeros(len(words.word) + 1, bool)
                first, shorter = words.phrases(size - 1)
                ok[first[_held(shorter, known)]] = True
                stays = ok[at] & ok[at + 1]
                at, h = at[stays], h[stays]
            if len(h):
                h, first, n = np.unique(h & MINED, return_index=True, return_counts=True)
                held.append((h, n, of[words.text[at[first]]]))
    return run


def _frequent(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is frequent in a shard, of one range of hashes."""
    h, n = np.concatenate([_hashes_of(x) for x in pdf["h"]]), np.concatenate([_numbers(x, np.int64) for x in pdf["n"]])
    first, n = _summed(h, n)
    least = int(pdf["least"].iloc[0])
    often = n >= least
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "h": h[first[often]].view(np.int64), "over": n[often] - (least - 1), "slack": pdf["slack"].iloc[0]})


def _count(longest: int, known, ranges: int):
    """Counts of the phrases that ``known`` lets through by 96 bits, with their words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, chunks, held = [], [], {k: [] for k in range(1, longest + 1)}

        def summed() -> int:
            for parts in held.values():
                if parts:
                    of, h, more, n, chunk, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                    first, n = _summed(h, n, more)
                    parts[:] = [(of[first], h[first], more[first], n, chunk[first], at[first])]
            return sum(len(parts[0][0]) for parts in held.values() if parts)

        def handed_on() -> Iterator[pd.DataFrame]:
            for size, parts in held.items():
                if parts and len(parts[0][0]):
                    of, h, more, n, chunk, at = parts.pop()
                    text = np.empty(len(h), object)
                    for c in np.unique(chunk).tolist():
                        own = np.flatnonzero(chunk == c)
                        text[own] = chunks[c].written(at[own], size)
                    yield _packed(langs, of, h, ranges, {"n": n, "text": text}, 0).drop(columns=["shard", "total"]).assign(size=size)
                parts.clear()
            chunks.clear()

        for langs, _, words, of in _chunks(batches):
            if words is None:
                continue
            for size in held:
                at, h = words.phrases(size)
                through = _held(h, known.value)
                at, h, more, n = words.counted(at[through], h[through], size)
                held[size].append((of[words.text[at]], h, more, n, np.full(len(at), len(chunks), np.int32), at.astype(np.int32)))
            chunks.append(words.light())
            if sum(len(x[0]) for parts in held.values() for x in parts) > HELD and summed() > HELD * 2 // 3:
                yield from handed_on()
        summed()
        yield from handed_on()
    return run


def _exact(support: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = np.array([None, *b"\n".join(pdf["text"]).split(b"\n")], object)[1:]
        which, phrases = pd.factorize(texts)
        order = np.argsort(which, kind="stable")
        n = np.add.reduceat(np.concatenate([_numbers(x, np.int64) for x in pdf["n"]])[order], np.flatnonzero(np.diff(which[order], prepend=-1)))
        often = np.flatnonzero(n >= support)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "size": pdf["size"].iloc[0], "phrase": np.array([None, *(phrases[i].decode() for i in often)], object)[1:], "a": n[often]})
    return run


def frequent_phrases(docs: DataFrame, longest: int, support: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of up to ``longest`` words that occur ``support`` times, and (lang, n) with all words."""
    spark = docs.sparkSession
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(shards)).cast("int")
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"))
    ranges = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (RANGE * shards) + 1
    by, found = ["lang", "shard", "range"], []
    for size in range(1, longest + 1):
        parts = _filter(spark, found[-1:]) if found else None
        mined = rows.mapInPandas(_mine(size, parts, ranges), "lang string, shard int, range long, total long, h binary, n binary")
        if size == 1:
            mined = keep(mined, "words")
            share = keep(mined.groupBy("lang", "shard").agg(F.sum("total").alias("of")), "share")
            totals = keep(share.groupBy("lang").agg(F.sum("of").alias("all")), "totals")
            least = keep(share.join(totals, "lang").select("lang", "shard", F.expr(f"({support} * of + `all` - 1) div `all`").alias("least")), "least")
            slack = least.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("slack"))
            least = keep(least.join(slack, "lang"), "slack")
        often = mined.join(least, ["lang", "shard"]).groupBy(*by).applyInPandas(_frequent, "lang string, h long, over long, slack long")
        often = often.groupBy("lang", "h").agg(F.sum("over").alias("over"), F.first("slack").alias("slack")).where(F.col("over") + F.col("slack") >= support)
        found.append(keep(often.select("lang", "h"), "candidates"))
    counted = rows.mapInPandas(_count(longest, _filter(spark, found), ranges * shards), "lang string, range long, n binary, text binary, size int")
    exact = counted.groupBy("lang", "size", "range").applyInPandas(_exact(support), "lang string, size int, phrase string, a long")
    return keep(exact.select("lang", "size", "phrase", "a"), "exact"), totals.select("lang", F.col("all").alias("n"))


def score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) of columns of whole numbers below 10^15, exactly."""
    big = lambda c: f"CAST({c} AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({big(a)} * {big(a)})) div ({big(l)} * {big(r)})")


def scored(exact: DataFrame, inside: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates among counted phrases that no longer one stands for.

    Of the cuts of a phrase in two the one of least score counts, the earliest among equals.
    """
    words = F.split("phrase", " ")
    many = exact.where("size >= 2").select("lang", "phrase", "a", "size", words.alias("ws"))
    cut = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    cuts = many.select("lang", "phrase", "a", "ws", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    # Written, so that joins read two plain exchanges, which adaptive execution splits where a word is very common.
    cuts = keep(cuts.select("lang", "phrase", "a", "cut", cut(F.lit(1), F.col("cut")).alias("first"), cut(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest")), "cuts")
    f = exact.select("lang", "phrase", "a")
    cuts = cuts.join(f.toDF("lang", "first", "l"), ["lang", "first"]).join(f.toDF("lang", "rest", "r"), ["lang", "rest"])
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score("a", "l", "r").alias("score"), "cut", "l", "r")).alias("b"))
    at = F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(ws, i, k), ' '))))"))
    held = many.where("size > 2").select("lang", at.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside} * a")
    return left.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


@tidy
def collocations(docs: DataFrame, longest: int = 3, support: int = 10, inside: int = 50, top: int = 2000, shards: int = 4) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to ``longest`` words of each language, by score, then a, then phrase.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words.  ``a``, ``l`` and ``r``
    count the phrase and the two parts of its lowest-scoring cut, overlaps included, ``n`` all words of the language.  A phrase that lies in a longer
    one with ``inside`` % of its occurrences or more is left out.  A null lang is ``und``; null and empty texts hold nothing, repeated
    rows count each, rows without doc_id too.  Further columns are ignored; an empty table gives nothing.  With more than ``support`` shards the
    lowered support is 1 in each, which is still complete.
    """
    exact, totals = frequent_phrases(docs, longest, support, shards)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = scored(exact, inside).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    next_ = {2: "ws[i] || ' ' || ws[i + 1]", 3: "ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]"}
    inner = " ".join(f"UNION ALL SELECT lang, {k}, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: {x})) FROM s" for k, x in next_.items())
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) AS piece FROM d),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM q),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM s {inner}) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
u AS MATERIALIZED (SELECT lang, phrase, a, 1 AS cut, ws[1] AS head, CASE k WHEN 2 THEN ws[2] ELSE ws[2] || ' ' || ws[3] END AS tail FROM c
      UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
v AS (SELECT u.lang, u.phrase, u.a, u.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS score FROM u
      JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""
