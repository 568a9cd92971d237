"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles.  Equal sets are one vertex.  Each
vertex carries 128 minwise values and a sketch of two bits of each.  In each of
``trees`` independent trees a vertex starts at the root and, in each node,
follows the minwise values at coordinates the node itself selects,
1/similarity of them on average, so that a pair at the threshold shares one
child on average.  Nodes of up to ``leaf`` vertices are compared exhaustively;
larger ones compare all members with one pivot and branch on.  Pairs whose
sizes and sketches allow the threshold are candidates.

Components of the candidates are clusters.  A node whose members are one
cluster is done; nodes that hold several branch on until a block holds
them, and what is still larger at ``depth`` is compared block by block, so
nothing is capped.  Inside each cluster full sets are then intersected, again
by pairs of blocks, and every pair that is not linked already is decided by
them.  What leaves a block are links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, mix, shingles, tidy, told_apart, word_hashes
from .graph import connected_components

_T = 128
_MULT = np.random.default_rng(7).integers(0, 2**63, _T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = ["s1", "s2", "s3", "s4"]
_VERTEX = "v long, n long, s1 long, s2 long, s3 long, s4 long"
#: Vertices, and shingles, that are compared in one task at once.
BLOCK, BLOCK_ITEMS = 4096, 2_000_000


def most_unlike(similarity: float) -> int:
    """Of 128 pairs of sketch bits, how many may differ: 3.7 deviations over the mean at the threshold."""
    p = 0.75 * (1 - similarity)
    return int(_T * p + 3.7 * (_T * p * (1 - p)) ** 0.5)


def _signature(items: np.ndarray) -> np.ndarray:
    low = np.full(_T, 2**64 - 1, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(low, (items[at:at + 2048, None] * _MULT).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _describe(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                items = shingles(word_hashes((text or "").encode()), size)
                if not len(items):
                    rows.append((0, *[None] * 7))
                    continue
                sig = _signature(items)
                v = int(np.bitwise_xor(mix(items).sum(dtype=np.uint64), np.uint64(len(items))).astype(np.int64))
                v2 = int(mix(items ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64).astype(np.int64))
                bits = mix(sig.astype(np.uint64))
                planes = [np.packbits(((bits >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist() for k in (0, 1)]
                rows.append((len(items), v, v2, *planes[0], *planes[1], sig.tobytes()))
            out = pd.DataFrame(rows, columns=["n", "v", "v2", *_SKETCH, "sig"], index=pdf.index, dtype=object)
            out.insert(0, "doc_id", pdf["doc_id"])
            out.insert(1, "th", pdf["th"])
            yield out
    return run


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), v and v2 (two 64-bit fingerprints of the set), sketch s1 to s4, minwise values sig."""
    # Ids travel as text, as pandas would turn those of a batch with a null into floats.
    rows = docs.select(F.col("doc_id").cast("string"), "text", F.xxhash64("text").alias("th")).mapInPandas(_describe(shingle), "doc_id string, th long, n long, v long, v2 long, s1 long, s2 long, s3 long, s4 long, sig binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _children(nodes: np.ndarray, sig: np.ndarray, similarity: float) -> list[list[int]]:
    """The children, in its node, of each row of minwise values."""
    h = mix(nodes.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    c1, c2 = (h % np.uint64(_T)).astype(int), ((h >> np.uint64(20)) % np.uint64(_T)).astype(int)
    more = (h >> np.uint64(40)) % np.uint64(1 << 20) < np.uint64(int((1 / similarity - 1) * (1 << 20)))
    at = np.arange(len(nodes))
    a, b = (mix(h ^ mix(sig[at, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(33)))).view(np.int64) for c in (c1, c2))
    return [[x, y] if m else [x] for x, y, m in zip(a.tolist(), b.tolist(), (more & (c1 != c2)).tolist(), strict=True)]


def _branch(similarity: float, trees: int):
    """From the roots if rows have no node, else from their nodes."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, _T)
            if "node" in pdf:
                nodes = _children(pdf["node"].to_numpy(np.int64), sig, similarity)
            else:
                per_tree = [_children(np.full(len(pdf), r), sig, similarity) for r in roots]
                nodes = [sum(x, []) for x in zip(*per_tree, strict=True)]
            yield pdf[["v", "n", *_SKETCH]].assign(nodes=nodes)
    return run


def _expand(df: DataFrame, similarity: float, trees: int) -> DataFrame:
    return df.mapInPandas(_branch(similarity, trees), _VERTEX + ", nodes array<long>").select("v", "n", *_SKETCH, F.explode("nodes").alias("node"))


def _alike(percent: int):
    """Sizes and sketches of a and b leave the threshold possible."""
    return F.expr(f"least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} and bit_count((a.s1 ^ b.s1) | (a.s3 ^ b.s3)) + bit_count((a.s2 ^ b.s2) | (a.s4 ^ b.s4)) <= {most_unlike(percent / 100)}")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair within a node."""
    return rows.alias("a").join(rows.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.v") < F.col("b.v")) & _alike(percent)).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))


def _with_pivot(rows: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair of a member with its node's pivot, the member of least hash."""
    cols = ["v", "n", *_SKETCH]
    pivot = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "v").alias("h"), *cols)).alias("p")).select("node", *[F.col(f"p.{x}").alias(x) for x in cols])
    pivot = keep(pivot, "pivot")  # so that the join reads two plain exchanges, which adaptive execution splits where a node is large
    return rows.alias("a").join(pivot.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.v") != F.col("b.v")) & _alike(percent)).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))


def _in_blocks(df: DataFrame, blocks: str) -> DataFrame:
    """Each row once for every pair of its group's ``blocks`` blocks that its own is in: columns b (its own), i and j."""
    df = df.withColumn("b", F.expr(f"pmod(xxhash64(v), {blocks})")).withColumn("o", F.explode(F.expr(f"sequence(0L, {blocks} - 1)")))
    return df.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o")


class _Block:
    """Members of one pair of blocks, joined up as pairs are found alike."""

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.v, self.n = pdf["v"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        self.s = [pdf[c].to_numpy(np.int64).view(np.uint64) for c in _SKETCH]  # bitwise_count takes absolute values of signed numbers
        self.b, self.cross = pdf["b"].to_numpy(np.int64), bool((pdf["i"] != pdf["j"]).iloc[0])
        self.percent, self.limit = percent, most_unlike(percent / 100)

    def candidates(self, x: int, comp: np.ndarray) -> np.ndarray:
        """Members after x that x may be alike and isn't joined to."""
        y = slice(x + 1, None)
        ok = comp[y] != comp[x]
        if self.cross:
            ok &= self.b[y] != self.b[x]
        at = np.flatnonzero(ok) + x + 1
        if not len(at):
            return at
        n = self.n[at]
        at = at[np.minimum(n, self.n[x]) * 100 >= np.maximum(n, self.n[x]) * self.percent]
        s = self.s
        bad = np.bitwise_count((s[0][at] ^ s[0][x]) | (s[2][at] ^ s[2][x])).astype(int) + np.bitwise_count((s[1][at] ^ s[1][x]) | (s[3][at] ^ s[3][x]))
        return at[bad <= self.limit]

    def edges(self, alike) -> tuple[np.ndarray, np.ndarray]:
        """Ends of a spanning forest of the pairs for which ``alike(x, members)`` holds."""
        comp = np.arange(len(self.v))
        for x in range(len(self.v) - 1):
            at = self.candidates(x, comp)
            if len(at):
                at = alike(x, at)
            if len(at):
                comp[np.isin(comp, comp[at])] = comp[x]
        moved = comp != np.arange(len(comp))
        return self.v[moved], self.v[comp[moved]]


def _block_candidates(percent: int):
    """Candidates, by sketch alone, between different clusters of one node's blocks."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, percent)
        c = pdf["c"].to_numpy(np.int64)
        a, b = block.edges(lambda x, at: at[c[at] != c[x]])
        return pd.DataFrame({"a": a, "b": b})
    return run


def _block_links(size: int, percent: int):
    """Links, by full sets, within clusters."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", kind="stable", ignore_index=True)
        out = []
        for _, part in pdf.groupby("c", sort=False):
            block = _Block(part, percent)
            sets = [shingles(word_hashes(t.encode()), size) for t in part["text"]]
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ends = np.cumsum([len(s) for s in sets])
            sets = np.split(ids, ends[:-1])
            n, mark = np.array([len(s) for s in sets]), np.zeros(int(ids.max()) + 1, bool)

            def alike(x, at):
                mark[sets[x]] = True
                both = np.add.reduceat(mark[np.concatenate([sets[y] for y in at])].astype(np.int64), np.concatenate([[0], np.cumsum(n[at])[:-1]]))
                mark[sets[x]] = False
                return at[100 * both >= percent * (n[at] + n[x] - both)]

            out.append(np.stack(block.edges(alike)))
        a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": a, "b": b})
    return run


def _links(clusters: DataFrame, vertices: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of a spanning forest of every cluster; full sets are made anew from the text of one document for each vertex."""
    members = vertices.select("v", "doc", "th", "n", *_SKETCH).join(clusters.select(F.col("id").alias("v"), F.col("component").alias("c")), "v")
    sizes = members.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).alias("blocks"), F.sum("n").alias("items"))
    sizes = keep(sizes, "sizes")
    together = max(1, -(-(sizes.where("blocks = 1").agg(F.sum("items")).first()[0] or 0) // BLOCK_ITEMS))
    members = members.join(sizes.drop("items"), "c").select("v", "n", *_SKETCH, "c", "blocks", F.col("doc").alias("doc_id"), "th")
    # By id and text: rows may repeat an id with another text.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(members, ["doc_id", "th"]).dropDuplicates(["v"])
    # Small clusters share a task; large ones have one for each pair of blocks.
    rows = _in_blocks(texts, "blocks").withColumn("task", F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(c), {4 * together})")).otherwise(F.col("c")))
    rows = rows.withColumn("large", F.col("blocks") > 1).select("task", "large", "i", "j", "b", "c", "v", "n", *_SKETCH, "text")
    return keep(rows.groupBy("task", "large", "i", "j").applyInPandas(_block_links(size, percent), "a long, b long"), "links")


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = 16, leaf: int = 64, depth: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``docs`` needs doc_id and text; further columns are ignored.  Texts that
    are null, empty or hold no word have 0 shingles and are linked with nothing:
    their component is their own id.  A row without doc_id is linked with
    nothing, has no component and is not kept.  Equal sets link at any size.
    Rows that repeat a doc_id appear as often as they came in; they are
    one document only if their sets are equal (by 128 bits of hash), else each has its own component
    and the id is that of the smallest in it.  An empty table gives none.
    """
    similarity = percent / 100
    described = keep(describe(docs, shingle), "sets")
    sets = told_apart(described)
    real = sets.where("v is not null and doc_id is not null")
    vertices = keep(real.groupBy("v").agg(F.min(F.struct("doc_id", "th")).alias("low"), *[F.first(c).alias(c) for c in ("n", *_SKETCH, "sig")]).select("v", F.col("low.doc_id").alias("doc"), "low.th", "n", *_SKETCH, "sig"), "vertices")
    # Signatures are needed once for each vertex only; tables go as soon as nothing reads them any more.
    sets = keep(sets.select("doc_id", "n", "v"), "ids")
    drop(described)
    signed = vertices.select("v", "sig")

    found, parts, large, rows = None, [], None, keep(_expand(vertices, similarity, trees), "nodes")
    for level in range(1, 4):
        sizes = keep(rows.groupBy("node").count().where("count > 1"), "sizes")
        grouped = keep(rows.join(sizes, "node"), "grouped")
        drop(rows)
        small, large = grouped.where(F.col("count") <= leaf).drop("count"), grouped.where(F.col("count") > leaf).drop("count")
        new = keep(_pairs(small, percent).unionByName(_with_pivot(large, percent)), "found")
        found = new if found is None else found.unionByName(new)
        drop(sizes)
        parts.append(new)
        if level < 3:
            rows = keep(_expand(large.join(signed, "v"), similarity, trees), "nodes")
            drop(grouped)
    clusters = keep(connected_components(found), "clusters")
    for x in parts:
        drop(x)

    def with_cluster(df: DataFrame) -> DataFrame:
        return df.join(clusters.select(F.col("id").alias("v"), "component"), "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")

    active, extra = with_cluster(large), None
    for level in range(4, depth + 1):
        sizes = active.groupBy("node").agg(F.count("*").alias("count"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("node", F.ceil(F.col("count") / BLOCK).alias("blocks"))
        grouped = keep(active.join(sizes, "node"), "grouped")
        if grouped.isEmpty():
            break
        now = grouped if level == depth else grouped.where("blocks = 1")
        new = keep(_in_blocks(now, "blocks").groupBy("node", "i", "j").applyInPandas(_block_candidates(percent), "a long, b long"), "found")
        extra = new if extra is None else extra.unionByName(new)
        active = with_cluster(_expand(grouped.where("blocks > 1").join(signed, "v"), similarity, trees))
    if extra is not None and not extra.isEmpty():
        old = clusters.select(F.col("id").alias("a"), F.col("component").alias("b"))
        clusters = keep(connected_components(old.unionByName(extra)), "clusters")

    comp = keep(connected_components(_links(clusters, vertices, docs, shingle, percent)), "comp")
    named = vertices.select("v", "doc").join(comp, F.col("v") == F.col("id")).select("v", "component", "doc")
    smallest = keep(named.groupBy("component").agg(F.min("doc").alias("low")), "smallest")
    label = vertices.select("v", "doc").join(named.join(smallest, "component").select("v", "low"), "v", "left")
    label = keep(label.select("v", F.coalesce("low", "doc").alias("low")), "label")
    own = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return (sets.select("doc_id", "n", "v").join(label, "v", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
