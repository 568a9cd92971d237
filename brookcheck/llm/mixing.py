"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are packed, in order of doc_id within streams of about a
million words, into blocks of 32.  Output shards of 4096 slots draw how many
blocks they take from each source: slot i of a shard draws a uniform number in
its own 1/n of the unit interval (a stratified multinomial draw, so that totals
stay within a few blocks of the targets), and the counts follow in closed form
from the cumulative shares, since only slots at the bounds between sources are
open.  Slot j of a source is its block ``(i * a + c) mod K`` with ``i = j mod K``,
where prime a and offset c belong to the source and the epoch ``j div K``: each
epoch takes every block once.  Blocks and slots are joined by source and index.

Every draw is a digest of its coordinates, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, keep, tidy, word_count

BLOCK, SLOTS, STREAM = 32, 4096, 1 << 20
#: Primes above any number of blocks, so that multiples of them permute the indices.
PRIMES = (1000000000000000003, 1000000000000000009, 2305843009213693951)


def _digest(*parts) -> Column:
    """The first 32 bits of an md5 as BIGINT."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, rn, weight, source_size, target for rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target above
    three times its source's size stops there and the excess is shared by
    weight: with sources in order of size by weight, the level of the shares is
    the greatest over all counts of sources that stop.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    per = per.withColumn("weight", (F.col("rn") - 1) % 3 + 1)
    before = W.orderBy(F.expr("source_size * 6 div weight"), "rn").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * 3).over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / open_weight.cast("double"))
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "rn", "weight", "source_size", F.least((F.col("source_size") * 3).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _drawn(shard_slots: Column, share: Column) -> Column:
    """Slots of a shard that fall below a cumulative share."""
    x = shard_slots * share
    whole = F.floor(x)
    return whole + F.when(_digest(F.lit("slot"), "shard", whole) / 4294967296.0 < x - whole, 1).otherwise(0)


def _before(df: DataFrame, value: str, index: str, name: str, group: int = 4096) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same rn with a lower ``index`` from 0 on.

    Sums run inside groups of ``group`` indices, and then over the groups, so that a
    source's rows never meet in one task.
    """
    df = keep(df.withColumn("_g", F.floor(F.col(index) / group)), "indexed")
    sums = df.groupBy("rn", "_g").agg(F.sum(value).alias("_n"))
    sums = keep(sums.select("rn", "_g", F.coalesce(F.sum("_n").over(W.partitionBy("rn").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_low")), "sums")
    own = F.coalesce(F.sum(value).over(W.partitionBy("rn", "_g").orderBy(index).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_own", own).join(sums, ["rn", "_g"]).withColumn(name, F.col("_own") + F.col("_low")).drop("_g", "_own", "_low")


class Mix:
    """The plan of a mix.  ``docs`` needs doc_id, text and source.

    A row is told by its id and 128 bits of hash of its text; rows that repeat both are interchangeable.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tl")), "sized")
        self.sources = keep(source_targets(self.sized), "sources")
        streams = F.greatest(F.lit(1), F.ceil(F.col("source_size") / STREAM))
        stream = _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % streams
        on = self.sized["source"].eqNullSafe(self.sources["source"])
        rows = self.sized.join(self.sources, on).where("size > 0").select("doc_id", self.sized["source"], "size", "th", "tl", "rn", stream.alias("stream"))
        in_order = W.partitionBy("rn", "stream").orderBy("doc_id", "size", "th", "tl").rowsBetween(W.unboundedPreceding, -1)
        self.placed = keep(rows.withColumn("at", F.coalesce(F.sum("size").over(in_order), F.lit(0))), "placed")
        lengths = self.placed.groupBy("rn", "stream").agg(F.sum("size").alias("words"))
        self.streams = keep(_before(lengths.withColumn("blocks", F.ceil(F.col("words") / BLOCK)), "blocks", "stream", "first"), "streams")

    def draws(self) -> DataFrame:
        """rn, shard, k (blocks of the source), start and n: the source's slots ``start`` to ``start + n - 1`` lie in the shard."""
        k = self.streams.groupBy("rn").agg(F.sum("blocks").alias("k"))
        s = self.sources.join(k, "rn").where("k > 0")
        s = s.withColumn("expected", F.col("k") * (F.col("target") / F.col("source_size")))
        in_order, everything = W.orderBy("rn").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
        s = s.withColumn("upto", F.sum("expected").over(in_order)).withColumn("below", F.lag("upto", 1, 0.0).over(W.orderBy("rn")))
        s = s.withColumn("whole", F.max("upto").over(everything)).withColumn("slots", F.ceil("whole"))
        # Groups of shards are dealt out before they are told apart.
        s = s.withColumn("group", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOTS} div 4096)"))).repartition("rn", "group")
        s = s.withColumn("shard", F.explode(F.expr(f"sequence(group * 4096, least(group * 4096 + 4095, (slots - 1) div {SLOTS}))")))
        size = F.least(F.lit(SLOTS).cast("long"), F.col("slots") - F.col("shard") * SLOTS)
        top = F.when(F.col("upto") == F.col("whole"), size).otherwise(_drawn(size, F.col("upto") / F.col("whole")))
        s = s.select("rn", "k", "shard", (top - _drawn(size, F.col("below") / F.col("whole"))).alias("n"))
        return _before(s, "n", "shard", "start").where("n > 0").repartition("rn", "shard")

    def slots(self) -> DataFrame:
        """rn, shard, j, idx: the block of each slot of each source; no block has more than three."""
        s = self.draws().withColumn("j", F.explode(F.expr("sequence(start, start + n - 1)"))).where("j < 3 * k")
        s = s.withColumn("epoch", F.floor(F.col("j") / F.col("k"))).withColumn("draw", _digest(F.lit("turn"), "rn", "epoch"))
        prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.col("draw") % len(PRIMES) + 1).cast("int"))
        wide = lambda c: c.cast("decimal(19,0)")
        idx = (wide(F.col("j") % F.col("k")) * wide(prime % F.col("k")) + wide(F.col("draw"))) % wide(F.col("k"))
        return s.select("rn", "shard", "j", idx.cast("long").alias("idx"))

    def pieces(self) -> DataFrame:
        """A row for each document and block it lies in: where in the document, how many words."""
        p = self.placed.join(self.streams.select("rn", "stream", "first"), ["rn", "stream"])
        p = p.withColumn("b", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")))
        low, high = F.greatest("at", F.col("b") * BLOCK), F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * BLOCK)
        return p.select("rn", "stream", "at", "doc_id", "th", "tl", "size", (F.col("first") + F.col("b")).alias("idx"), (low - F.col("at")).alias("skip"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per row of the documents."""
        times = keep(self.slots().groupBy("rn", "idx").agg(F.count("*").alias("times")), "times")
        by = self.pieces().join(times, ["rn", "idx"], "left").groupBy("rn", "stream", "at", "doc_id", "size")
        full = by.agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).select("doc_id", "rn", "size", "taken")
        on = self.sized["source"].eqNullSafe(self.sources["source"])
        empty = self.sized.where("size = 0").join(self.sources, on).select("doc_id", "rn", "size", F.lit(0).cast("long").alias("taken"))
        return full.unionByName(empty).join(self.sources, "rn").select("doc_id", "size", "source_size", "target", "taken")

    def blocks(self) -> DataFrame:
        """shard, j, source, text: the mixed blocks themselves.

        Words of a document are cut by block; blocks of the corpus are put
        together from their pieces and joined to the slots that take them.
        Each piece gets the one text of its id and hash.
        """
        texts = self.docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("tl")).dropDuplicates(["doc_id", "th", "tl"])
        texts = texts.select(F.col("doc_id").alias("_id"), "th", "tl", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("all")).where(F.size("all") > 0)
        cut = self.pieces().join(texts, ["th", "tl"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
        cut = cut.select("rn", "idx", "stream", "at", F.expr("slice(all, cast(skip + 1 as int), cast(words as int))").alias("part"))
        whole = cut.groupBy("rn", "idx").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
        whole = whole.select("rn", "idx", F.array_join(F.flatten("parts.part"), " ").alias("text"))
        return self.slots().join(whole, ["rn", "idx"]).join(self.sources.select("rn", "source"), "rn").select("shard", "j", "source", "text")


@tidy
def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    A null text has size 0; a null source is a source like any other, the last.
    Rows that repeat a doc_id are documents of their own.  A source without
    words has target 0.  Further columns are ignored; an empty table gives none.
    Sources are ranked in one task: their table, a row each, is taken to be small beside the documents.
    """
    return Mix(docs).taken()


SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM per),
weighed AS (SELECT *, (rn - 1) % 3 + 1 AS weight FROM ranked),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
    FROM weighed WINDOW b AS (ORDER BY source_size * 6 // weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (SELECT source, rn, weight, source_size, least(CAST(source_size * 3 AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
placed0 AS (SELECT d.doc_id, d.size, s.rn, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % CAST(greatest(1, ceil(s.source_size / {STREAM})) AS BIGINT) AS stream
    FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source WHERE size > 0),
placed AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY rn, stream ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM placed0),
streams0 AS (SELECT rn, stream, CAST(ceil(sum(size) / {BLOCK}) AS BIGINT) AS blocks FROM placed GROUP BY rn, stream),
streams AS (SELECT *, CAST(coalesce(sum(blocks) OVER (PARTITION BY rn ORDER BY stream ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM streams0),
k AS (SELECT rn, CAST(sum(blocks) AS BIGINT) AS k FROM streams GROUP BY rn),
e AS (SELECT s.rn, k.k, k.k * (s.target / s.source_size) AS expected FROM sources s JOIN k ON k.rn = s.rn),
c AS (SELECT *, sum(expected) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e),
c2 AS (SELECT *, lag(upto, 1, 0.0) OVER (ORDER BY rn) AS below, max(upto) OVER () AS whole FROM c),
c3 AS (SELECT *, CAST(ceil(whole) AS BIGINT) AS slots FROM c2),
sh AS (SELECT *, unnest(range(0, (slots - 1) // {SLOTS} + 1)) AS shard FROM c3),
x AS (SELECT *, least({SLOTS}, slots - shard * {SLOTS}) AS size, least({SLOTS}, slots - shard * {SLOTS}) * (upto / whole) AS xu, least({SLOTS}, slots - shard * {SLOTS}) * (below / whole) AS xb FROM sh),
drawn AS (SELECT rn, k, shard,
    CASE WHEN upto = whole THEN size ELSE CAST(floor(xu) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('slot:' || shard || ':' || CAST(floor(xu) AS BIGINT)), 1, 8) AS BIGINT) / 4294967296.0 < xu - floor(xu) THEN 1 ELSE 0 END END
    - (CAST(floor(xb) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('slot:' || shard || ':' || CAST(floor(xb) AS BIGINT)), 1, 8) AS BIGINT) / 4294967296.0 < xb - floor(xb) THEN 1 ELSE 0 END) AS n FROM x),
starts AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY rn ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM drawn),
j AS (SELECT rn, k, unnest(range(start, start + n)) AS j FROM starts WHERE n > 0),
t AS (SELECT rn, k, j % k AS i, CAST('0x' || substr(md5('turn:' || rn || ':' || (j // k)), 1, 8) AS BIGINT) AS draw FROM j WHERE j < 3 * k),
slots AS (SELECT rn, CAST((CAST(i AS HUGEINT) * ([{', '.join(map(str, PRIMES))}][draw % {len(PRIMES)} + 1] % k) + draw) % k AS BIGINT) AS idx FROM t),
times AS (SELECT rn, idx, count(*) AS times FROM slots GROUP BY rn, idx),
p AS (SELECT d.*, s.first, unnest(range(d.pos // {BLOCK}, (d.pos + d.size - 1) // {BLOCK} + 1)) AS b FROM placed d JOIN streams s ON s.rn = d.rn AND s.stream = d.stream),
pieces AS (SELECT rn, stream, pos, doc_id, size, first + b AS idx, least(pos + size, (b + 1) * {BLOCK}) - greatest(pos, b * {BLOCK}) AS words FROM p),
full_docs AS (SELECT p.doc_id, p.rn, p.size, CAST(sum(words * coalesce(times, 0)) AS BIGINT) AS taken FROM pieces p LEFT JOIN times t ON t.rn = p.rn AND t.idx = p.idx GROUP BY p.rn, p.stream, p.pos, p.doc_id, p.size),
every AS (SELECT * FROM full_docs UNION ALL SELECT d.doc_id, s.rn, d.size, 0 FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source WHERE d.size = 0)
SELECT e.doc_id, e.size, s.source_size, s.target, e.taken FROM every e JOIN sources s ON s.rn = e.rn"""
