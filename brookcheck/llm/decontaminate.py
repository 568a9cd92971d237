"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a fixed mask over up to ten words that reads four and ignores the others, so a
substituted word hides only the seeds that read it.  Seeds of the benchmark are broadcast, in
as many blocks as its size needs, to the documents, whose seeds never leave the task
they are made in.  A hit fixes an alignment of item and document, and the words
around it are compared there and then.  What agrees well enough is then looked at
as a whole: over all of the item, over its best passage, and along neighbouring
alignments, as words that were put in or left out shift what follows.  Items too
short for the masks are sought by pieces of which one is whole in any text that
holds enough of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy

#: Word offsets that each mask reads.  Of 15 to 59 words of which any 60 % agree, these masks together miss less than one item in a hundred.
MASKS = ((0, 2, 3, 4), (0, 1, 4, 6), (0, 1, 7, 8), (0, 1, 3, 6), (0, 1, 5, 9))
#: Items of fewer words are sought by pieces.
SHORT = 11
#: Seeds, or hits, of up to this many are broadcast at once (40 bytes each).
BROADCAST_SEEDS = 500_000
#: Words of all items that are broadcast beside the seeds (8 bytes each).
BROADCAST_WORDS = 4_000_000
#: A passage of an item: so many consecutive words, of which so many agree at one alignment.
PASSAGE, PASSAGE_LEAST = 30, 24
#: Alignments up to so many words aside are added up, from one that holds this share of the item; each change of alignment costs so many words.
BAND, BAND_FROM, SHIFT_COSTS = 3, 0.3, 2
#: Items of fewer words count only where they are the whole text.
ALONE = 4


def _words(text: str):
    """Hashes of the words of a text in lower case; none for null and blank texts."""
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def _pieces(n: int, least: int) -> list[tuple[int, int]]:
    """(offset, words) of equal parts of an item of ``n`` words; one stays whole if ``least`` words agree."""
    parts = n - least + 1
    at = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _reads(offsets, kind: int, h: str, at: str) -> Column:
    """The seed that starts at word ``at`` of ``h``, null where the words end before it does."""
    words = ", ".join(f"{h}[{at} + {o}]" for o in offsets)
    return F.expr(f"if({at} + {offsets[-1]} < size({h}), xxhash64({kind}, {words}), null)")


def _item_seeds(items: DataFrame, short: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """seed, item_id, k, n and q, the word of the item at which the seed starts."""
    n = F.size("g")
    long = items.where(n >= SHORT).select("item_id", "k", "g", F.explode(F.expr("sequence(0, size(g) - 1)")).alias("q"))
    long = long.select("item_id", "k", F.size("g").alias("n"), "q", F.explode(F.array(*[_reads(m, i, "g", "q") for i, m in enumerate(MASKS)])).alias("seed"))
    for size, pieces in short.items():
        each = F.array(*[F.struct(F.lit(a).alias("q"), _reads(range(m), -m, "g", str(a)).alias("seed")) for a, m in pieces])
        long = long.unionByName(items.where(n == size).select("item_id", "k", n.alias("n"), F.inline(each)))
    return long.where("seed is not null").distinct()


def _hits(words: DataFrame, items: DataFrame, seeds: DataFrame, runs: list[int]) -> DataFrame:
    """doc_id, item_id, k and start of alignments at which enough words agree to look further."""
    each = words.select("doc_id", "h", F.explode(F.expr("sequence(0, size(h) - 1)")).alias("p"))
    made = [_reads(m, i, "h", "p") for i, m in enumerate(MASKS)] + [_reads(range(m), -m, "h", "p") for m in runs]
    each = each.select("doc_id", "h", "p", F.explode(F.array(*made)).alias("seed")).join(F.broadcast(seeds), "seed")
    start = F.col("p") - F.col("q")
    part = F.expr("slice(h, greatest(p - q, 0) + 1, least(n, size(h) - p + q) - greatest(q - p, 0))")
    each = each.select("doc_id", "item_id", "k", "n", start.alias("start"), part.alias("part")).join(items, ["item_id", "k"])
    agree = F.size(F.filter(F.zip_with("part", F.expr("slice(g, greatest(-start, 0) + 1, size(part))"), lambda x, y: x == y), lambda x: x))
    enough = F.least(F.lit(PASSAGE_LEAST), F.greatest(F.least(F.col("n"), F.lit(5)), BAND_FROM * F.col("n")))
    return each.where(agree >= enough).select("doc_id", "item_id", "k", "start")


@tidy
def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, least: int = 8) -> DataFrame:
    """doc_id, item_id, matched, item_words, start: documents that hold a benchmark item, at the alignment that matches best.

    An item is held when at least ``share`` of its words, and ``least`` of
    them, agree in place; ``start`` is the document's word at which the item
    starts (below 0 where its head is cut off).  It is also held when ``PASSAGE_LEAST`` of
    ``PASSAGE`` consecutive words agree in place, whatever the item's length, or when its ``share``
    agrees along alignments at most ``BAND`` words beside ``start``, which itself has ``BAND_FROM`` of
    them, and each change of which costs ``SHIFT_COSTS``
    words; matched is then the greatest count along them.  Alignments that hold the item as
    a whole go before others.  Words are compared in lower
    case.  Ties go to the first start.  An item of fewer than ``least`` words is held where all
    of them agree, one of fewer than ``ALONE`` only by a text of these words alone.
    Null and empty texts and items, and rows without an id, hold nothing.
    Rows that repeat an id are looked at one by one and the best
    is returned.  Further columns are ignored; an empty table gives none.
    """
    items = benchmark.where("item_id is not null").select("item_id", _words("text").alias("g")).where(F.size("g") > 0)
    items = keep(items.select("item_id", F.xxhash64("item_id", "g").alias("k"), "g").distinct(), "items")
    lengths = sorted(r[0] for r in items.where(F.size("g") < SHORT).select(F.size("g")).distinct().collect())
    short = {n: _pieces(n, min(n, max(least, math.ceil(share * n)))) for n in lengths}
    runs = sorted({m for of in short.values() for _, m in of})
    seeds = keep(_item_seeds(items, short), "seeds")
    n_seeds, n_words = seeds.count(), items.agg(F.sum(F.size("g"))).first()[0] or 0
    words = docs.where("doc_id is not null").select("doc_id", _words("text").alias("h")).where(F.size("h") > 0)
    sent = F.broadcast(items) if n_words <= BROADCAST_WORDS else items
    hits, blocks = None, max(1, -(-n_seeds // BROADCAST_SEEDS))
    for block in range(blocks):
        own = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed", "k", "q"), F.lit(blocks)) == block)
        new = keep(_hits(words, sent, own, runs).distinct(), "hits")
        hits = new if hits is None else hits.unionByName(new)
    hits = hits.distinct() if blocks > 1 else hits

    few = F.broadcast(hits) if hits.count() <= BROADCAST_SEEDS else hits
    texts = docs.join(few.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _words("text").alias("h"))
    around = F.expr(f"slice(h, greatest(start - {BAND}, 0) + 1, n + {2 * BAND})")
    both = texts.join(few.join(sent, ["item_id", "k"]).withColumn("n", F.size("g")), "doc_id").select("doc_id", "item_id", "g", "n", "start", F.size("h").alias("of"), F.greatest(F.col("start") - BAND, F.lit(0)).alias("from"), around.alias("h"))
    # A document's word at start + i lies at start + i - from in what was cut out.
    both = both.withColumn("agree", F.expr("transform(sequence(0, n - 1), i -> coalesce(get(h, start + i - from) = g[i], false))"))
    both = both.withColumn("matched", F.size(F.filter("agree", lambda x: x)).cast("long")).withColumn("item_words", F.col("n").cast("long"))
    enough = lambda c: (F.col(c) >= least) & (F.col(c) >= share * F.col("item_words"))
    all_of = (F.col("n") < least) & (F.col("matched") == F.col("n")) & ((F.col("n") >= ALONE) | (F.col("of") == F.col("n")))
    along = F.expr(f"""aggregate(sequence(0, n - 1), array_repeat(0, {2 * BAND + 1}), (s, i) ->
        transform(s, (x, d) -> greatest(x, array_max(s) - {SHIFT_COSTS}) + if(coalesce(get(h, start + i + d - {BAND} - from) = g[i], false), 1, 0)), s -> array_max(s))""")
    passage = F.expr(f"exists(sequence(0, greatest(0, n - {PASSAGE})), j -> size(filter(slice(agree, j + 1, {PASSAGE}), x -> x)) >= {PASSAGE_LEAST})")
    both = both.withColumn("whole", enough("matched") | all_of)
    both = both.withColumn("matched", F.when(F.col("whole"), F.col("matched")).otherwise(F.greatest("matched", F.when(F.col("matched") >= BAND_FROM * F.col("n"), along.cast("long")).otherwise(0))))
    held = both.where(F.col("whole") | enough("matched") | passage)
    best = held.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "item_words", "start"), F.struct("whole", "matched", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.item_words", F.col("b.start").cast("long").alias("start"))


def sql(share: float = 0.6, least: int = 8) -> str:
    """The rule itself, without seeds: words that agree at every alignment are counted; alignments are not added up."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS h FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT row_number() OVER () AS k, item_id, {words} AS g FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT r, doc_id, len(h) AS size, unnest(h) AS w, unnest(range(0, len(h))) AS p FROM d),
bw AS (SELECT k, item_id, len(g) AS n, unnest(g) AS w, unnest(range(0, len(g))) AS q FROM b),
c AS (SELECT r, doc_id, k, item_id, size, n, p - q AS start, count(*) AS matched FROM dw JOIN bw ON dw.w = bw.w GROUP BY ALL HAVING count(*) >= {PASSAGE_LEAST} OR count(*) = n OR count(*) >= {share} * n AND count(*) >= {least}),
pq AS (SELECT c.r, c.k, c.start, bw.q FROM c JOIN bw ON bw.k = c.k JOIN dw ON dw.r = c.r AND dw.w = bw.w AND dw.p = c.start + bw.q WHERE c.matched >= {PASSAGE_LEAST}),
ps AS (SELECT r, k, start, max(m) AS m FROM (SELECT r, k, start, count(*) OVER (PARTITION BY r, k, start ORDER BY q RANGE BETWEEN CURRENT ROW AND {PASSAGE - 1} FOLLOWING) AS m FROM pq) GROUP BY r, k, start),
held AS (SELECT c.*, (matched >= {least} AND matched >= {share} * n) OR (n < {least} AND matched = n AND (n >= {ALONE} OR n = size)) AS whole, coalesce(ps.m, 0) >= {PASSAGE_LEAST} AS passage FROM c LEFT JOIN ps ON ps.r = c.r AND ps.k = c.k AND ps.start = c.start),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY whole DESC, matched DESC, start) AS i FROM held WHERE whole OR passage)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(n AS BIGINT) AS item_words, CAST(start AS BIGINT) AS start FROM o WHERE i = 1"""
