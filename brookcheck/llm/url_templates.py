"""URLs judged by rules, and elsewhere by the path templates of their host.

The paths of a host form a tree of segments, which is generalised from the top, a level at a time for
all hosts at once.  At each node a segment stays as it is where it occurs ``LEAST``
times and makes up a share of the node's pages of one in ``SHARE`` or more.  All others are variable: they become
the wildcard ``*``.  Then branches that stay and are statistically alike become one, so their
subtrees grow together: labelled branches are put in the order of their share of bad
pages, and neighbours whose shares no two-sided test of proportions tells apart (5 %) merge.  Branches without any label
say nothing and merge with each other alone.  Levels below ``DEPTH`` are one wildcard ``**``.

What is labelled are the pages that a rule decides, and further ones that are given.  A template's
share of bad pages among its labelled ones, smoothed by ``WEIGHT`` clean pages, rejects it from one half on:
few labels reject nothing, and a template without any is allowed.

Pages are counted by host and path first, so a host with a third of all pages is a row for each of its
paths, and every level groups and joins by host, template and segment.  No node's children meet in one task but
those that stay, of which there are no more than ``SHARE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, tidy

DEPTH, LEAST, SHARE, WEIGHT = 8, 2, 16, 5
#: Squared normal deviate at which two shares differ at the level of 5 %.
DEVIATE = 3.8416

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What templates mean something by is escaped in segments.
_MARKS = (("%", "%25"), ("*", "%2A"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``.  Both empty without ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), *_AZ), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (host, path, verdict) that fits: its host or a subdomain, and a path that starts with its own.

    Length is that of host and path together; among equals the longer host wins, then ``block``.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = lambda h, p: ((host == h) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order], none)


def _alike(l1: str, b1: str, l2: str, b2: str) -> str:
    """SQL: whether the shares b1 of l1 and b2 of l2 cannot be told apart.  Cast to doubles, so that both engines compute the same."""
    a, b, c, d = (f"CAST({x} AS DOUBLE)" for x in (l1, b1, l2, b2))
    return f"({b} * {c} - {d} * {a}) * ({b} * {c} - {d} * {a}) * ({a} + {c}) <= CAST({DEVIATE} AS DOUBLE) * {a} * {c} * ({b} + {d}) * ({a} + {c} - {b} - {d})"


def _named(seg: Column) -> Column:
    for mark, code in _MARKS:
        seg = F.replace(seg, F.lit(mark), F.lit(code))
    return seg


def templates(paths: DataFrame) -> DataFrame:
    """host, path, template, n, lab, bad of different (host, path) with the numbers of their pages, labelled and bad ones."""
    segs = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/"))
    at = keep(paths.select("host", "path", "n", "lab", "bad", segs.alias("segs"), F.lit("").alias("template")), "paths")
    node = ["host", "template"]
    for level in range(1, DEPTH + 1):
        here = at.where(F.size("segs") >= level)
        if here.isEmpty():
            break
        seg = F.get("segs", F.lit(level - 1))
        child = keep(here.groupBy(*node, seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")]), "children")
        total = keep(child.groupBy(*node).agg(F.sum("n").alias("total")), "nodes")
        stay = child.join(total, node).where(f"n >= {LEAST} and {SHARE} * n >= total")
        order = W.partitionBy(*node).orderBy(F.expr("lab > 0"), F.expr("CASE WHEN lab > 0 THEN CAST(bad AS DOUBLE) / CAST(lab AS DOUBLE) ELSE 0 END"), "seg")
        stay = stay.withColumn("l0", F.lag("lab").over(order)).withColumn("b0", F.lag("bad").over(order))
        new = F.expr(f"CASE WHEN l0 IS NULL THEN 1 WHEN (l0 > 0) <> (lab > 0) THEN 1 WHEN lab = 0 THEN 0 WHEN {_alike('l0', 'b0', 'lab', 'bad')} THEN 0 ELSE 1 END")
        stay = stay.withColumn("new", new).withColumn("k", F.sum("new").over(order))
        names = stay.groupBy(*node, "k").agg(F.array_sort(F.collect_list("seg")).alias("segs"))
        label = F.array_join(F.transform("segs", _named), "|")
        names = names.select(*node, "segs", F.when(F.size("segs") > 1, F.concat(F.lit("{"), label, F.lit("}"))).otherwise(label).alias("label"))
        names = keep(names.select(*node, F.explode("segs").alias("seg"), "label"), "branches")
        longer = F.when(F.size("segs") >= level, F.concat("template", F.lit("/"), F.coalesce("label", F.lit("*")))).otherwise(F.col("template"))
        at = keep(at.withColumn("seg", seg).join(names, [*node, "seg"], "left").select("host", "path", "n", "lab", "bad", "segs", longer.alias("template")), "paths")
    return at.withColumn("template", F.when(F.size("segs") > DEPTH, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("segs")


@tidy
def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template: ``allow`` or ``block``, by the longest rule that fits, else by the template.

    ``rules`` are (host, path, verdict), a list that is part of the plan.  ``labels`` may
    give page_id and bad (boolean) of further pages; those that a rule decides keep its label.  A null url, or one without ``://``, has an empty host and
    path, and an empty template.  Every row is judged, repeated ones alike; rows without page_id too.  Further columns
    are ignored, and an empty table stays empty.  Without any labelled page the method allows everything.
    """
    host, path = split_url(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    given = F.lit(None).cast("boolean")
    if labels is not None:
        known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.bool_or("bad").alias("given"))
        rows, given = rows.join(known, "page_id", "left"), F.col("given")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    counted = rows.withColumn("given", given).groupBy("host", "path").agg(F.count("*").alias("n"), F.count("given").alias("lab"), F.count_if("given").alias("bad"))
    counted = counted.withColumn("r", rule)
    lab, bad = F.when(F.col("r").isNotNull(), F.col("n")).otherwise(F.col("lab")), F.when(F.col("r.verdict") == "block", F.col("n")).when(F.col("r").isNotNull(), 0).otherwise(F.col("bad"))
    at = keep(templates(counted.select("host", "path", "n", lab.alias("lab"), bad.alias("bad"))), "templates")
    sums = keep(at.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")), "sums")
    judged = sums.select("host", "template", F.when(F.col("bad") * 2 >= F.col("lab") + WEIGHT, "block").otherwise("allow").alias("own"))
    judged = keep(at.select("host", "path", "template").join(judged, ["host", "template"]), "judged")
    out = rows.select("page_id", "host", "path").join(judged, ["host", "path"]).withColumn("r", rule)
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "own").alias("verdict"), "template")


def sql(rules: list[tuple[str, str, str]]) -> str:
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    when = lambda value: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in order)
    named = "seg"
    for mark, code in _MARKS:
        named = f"replace({named}, '{mark}', '{code}')"
    steps = []
    for i in range(1, DEPTH + 1):
        steps.append(f"""
c{i} AS MATERIALIZED (SELECT host, template, segs[{i}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM t{i - 1} WHERE len(segs) >= {i} GROUP BY ALL),
s{i} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM c{i}) WHERE n >= {LEAST} AND {SHARE} * n >= total),
o{i} AS (SELECT *, lag(lab) OVER w AS l0, lag(bad) OVER w AS b0, row_number() OVER w AS nth FROM s{i} WINDOW w AS (PARTITION BY host, template ORDER BY lab > 0, CASE WHEN lab > 0 THEN CAST(bad AS DOUBLE) / CAST(lab AS DOUBLE) ELSE 0 END, seg)),
k{i} AS (SELECT *, sum(CASE WHEN l0 IS NULL THEN 1 WHEN (l0 > 0) <> (lab > 0) THEN 1 WHEN lab = 0 THEN 0 WHEN {_alike('l0', 'b0', 'lab', 'bad')} THEN 0 ELSE 1 END) OVER (PARTITION BY host, template ORDER BY nth) AS k FROM o{i}),
b{i} AS (SELECT host, template, seg, CASE WHEN count(*) OVER g > 1 THEN '{{' || string_agg({named}, '|') OVER (PARTITION BY host, template, k ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || '}}' ELSE {named} END AS label FROM k{i} WINDOW g AS (PARTITION BY host, template, k)),
t{i} AS MATERIALIZED (SELECT x.host, x.path, x.n, x.lab, x.bad, x.segs, CASE WHEN len(x.segs) >= {i} THEN x.template || '/' || coalesce(label, '*') ELSE x.template END AS template
  FROM t{i - 1} x LEFT JOIN b{i} y ON x.host = y.host AND x.template = y.template AND x.segs[{i}] = y.seg)""")
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
r AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), '{_AZ[0]}', '{_AZ[1]}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
u AS (SELECT host, path, count(*) AS n, CASE {when(lambda h, p, v: v)} END AS verdict FROM r GROUP BY host, path),
t0 AS MATERIALIZED (SELECT host, path, n, CASE WHEN verdict IS NULL THEN 0 ELSE n END AS lab, CASE WHEN verdict = 'block' THEN n ELSE 0 END AS bad,
  CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS segs, '' AS template FROM u),{",".join(steps)},
z AS MATERIALIZED (SELECT host, path, lab, bad, template || CASE WHEN len(segs) > {DEPTH} THEN '/**' ELSE '' END AS template FROM t{DEPTH}),
m AS (SELECT host, template, CASE WHEN sum(bad) * 2 >= sum(lab) + {WEIGHT} THEN 'block' ELSE 'allow' END AS own FROM z GROUP BY host, template)
SELECT page_id, r.host, r.path, CASE {when(lambda h, p, v: h + p)} END AS rule, coalesce(CASE {when(lambda h, p, v: v)} END, own) AS verdict, z.template
FROM (SELECT page_id, host, path FROM r) r JOIN (SELECT host AS zh, path AS zp, template FROM z) z ON zh = r.host AND zp = r.path JOIN (SELECT host AS mh, template AS mt, own FROM m) m ON mh = r.host AND mt = z.template"""
