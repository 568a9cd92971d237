"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns, on a bounded sample, rotations of the leading
principal axes whose signs are balanced binary codes.  Codes of several starts
are laid end to end and cut into disjoint substrings, each the key of one
table.  Vectors that share a bucket of any table, and whose first 64 code bits
are near, are candidates; cosines of the original vectors in double precision
decide.  The substring grows with the number of vectors, so a
bucket of unrelated vectors stays small, and the number of tables follows from
the chance, at the threshold, that all of a substring's bits agree.  Where vectors
have a direction in common, taking it off parts unrelated ones but widens the angle of near ones too: how
much of it goes, and how wide a substring is, is what costs least on the sample.

A pair is decided in the first table in which its substrings agree, and only
there.  Buckets of more than about ``DENSE`` vectors are compared block by block; what
leaves a block are how many links each vector has and a spanning forest of
them, so a group of near-equal vectors is never listed as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy, told_apart
from .graph import connected_components

#: Buckets of more vectors than that are compared in blocks of ``BLOCK``; every ``PROBE``-th vector tells how many a bucket holds.
DENSE, PROBE, BLOCK = 256, 8, 2048
#: Pairs that are compared at the cost of shuffling one row.
PAIRS = 100


def learn(sample: np.ndarray, bits: int, starts: int, centred: float = 1.0, rounds: int = 25, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(shift, projection): signs of ``(x - shift) @ projection`` are ``starts`` codes of up to ``bits`` bits.

    Rotations are learned on the centred sample; the shift is the share ``centred`` of its mean.
    """
    dim = sample.shape[1]
    bits = min(bits, dim)
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    if len(sample) > bits:
        off = sample - centred * mean
        _, axes = np.linalg.eigh(off.T @ off / len(sample))
        axes = axes[:, ::-1][:, :bits]
    else:
        axes = np.eye(dim)[:, :bits]
    flat = (sample - mean) @ axes
    out = []
    for _ in range(starts):
        turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds if len(sample) > bits else 0):
            left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (left @ right).T
        out.append(axes @ turn)
    return centred * mean, np.concatenate(out, axis=1)


def agreement(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, cosine: float, seed: int = 12) -> np.ndarray:
    """For each unit vector of a sample, the chance that a bit of it and of a vector at the threshold agree.

    The other vector lies off in a random direction, or in that of another of
    the sample, whichever makes the angle wider once both are centred and projected.
    """
    rng = np.random.default_rng(seed)
    low = np.ones(len(x))
    own = (x - mean) @ axes
    for off in (rng.standard_normal(x.shape), x[rng.permutation(len(x))] - x):
        off = off - (off * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(off, axis=1, keepdims=True)
        other = (cosine * x + math.sqrt(1 - cosine**2) * off / np.where(size > 0, size, 1) - mean) @ axes
        lengths = np.linalg.norm(own, axis=1) * np.linalg.norm(other, axis=1)
        angle = np.arccos(np.clip((own * other).sum(axis=1) / np.where(lengths > 0, lengths, 1), -1, 1))
        low = np.where(size[:, 0] > 1e-9, np.minimum(low, 1 - angle / math.pi), low)
    return np.where(low < 1, low, 1 - math.acos(cosine) / math.pi)


def unrelated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, cosine: float, seed: int = 13) -> np.ndarray:
    """For random pairs of a sample, the chance that a bit agrees; 0 for pairs that link, which have to be met anyway."""
    other = np.random.default_rng(seed).permutation(len(x))
    a, b = (x - mean) @ axes, (x[other] - mean) @ axes
    lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    angle = np.arccos(np.clip((a * b).sum(axis=1) / np.where(lengths > 0, lengths, 1), -1, 1))
    return np.where((x * x[other]).sum(axis=1) >= cosine, 0.0, 1 - angle / math.pi)


def tables_needed(agree: np.ndarray, width: int, miss: float) -> int:
    """Tables of ``width`` bits by all of which a pair, whose bits agree with chances ``agree``, is missed with probability ``miss`` on average."""
    share = np.clip(agree, 0.5, 1 - 1e-9) ** width
    missed = lambda tables: float(np.mean(np.exp(tables * np.log1p(-share))))
    low, high = 0, 1
    while missed(high) > miss:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > miss else (low, mid)
    return high


def plan(n: int, samples: list[np.ndarray], cosine: float, miss: float) -> tuple[float, int, int, np.ndarray]:
    """(share of the mean taken off, bits of a substring, tables, chances that bits of a pair at the threshold agree) of least cost.

    Taking the mean off parts unrelated vectors, but widens the angle of near ones; so do wide
    substrings.  The cost is a row for each vector and table, and a ``PAIRS``-th of one for each unrelated pair in a bucket.
    """
    best = None
    for centred in (1.0, 0.75, 0.5, 0.25, 0.0):
        models = [(x, *learn(x, 64, 1, centred, rounds=0)) for x in samples]
        agree = np.concatenate([np.array([1 - math.acos(cosine) / math.pi]), *[agreement(*m, cosine) for m in models]])
        apart = np.concatenate([np.array([0.5]), *[unrelated(*m, cosine) for m in models]])
        for width in range(4, 31):
            tables = tables_needed(agree, width, miss)
            cost = tables * (1 + n * float(np.mean(apart**width)) / PAIRS)
            if best is None or cost < best[0]:
                best = cost, centred, width, tables, agree
    return best[1:]


def _encode(models: dict[int, tuple[np.ndarray, np.ndarray]], width: int, tables: int, starts: int):
    weights, first = (1 << np.arange(width)).astype(np.int64), np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = dict(models)
        for pdf in batches:
            for dim, rows in pdf.groupby(pdf["vec"].map(len)):
                if dim not in own:  # a length that the sample didn't hold: random rotations
                    need = math.ceil(tables * width / min(64, dim))
                    own[dim] = learn(np.zeros((0, dim)), 64, max(starts, need))
                mean, axes = own[dim]
                x = np.array(rows["vec"].tolist(), np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                bits = (x - mean) @ axes > 0
                keys = (bits[:, : tables * width].reshape(len(x), tables, width) @ weights).astype(np.int32)
                near = np.zeros((len(x), 64), bool)
                near[:, : min(64, bits.shape[1])] = bits[:, :64]
                yield pd.DataFrame({"v": rows["v"].to_numpy(), "kind": rows["kind"].to_numpy(), "code": (near @ first).view(np.int64), "keys": list(keys)})
    return run


@tidy
def similar_vectors(rows: DataFrame, cosine: float = 0.93, miss: float = 1e-3, fit_rows: int = 8000) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``rows``.

    ``rows`` needs vec_id, embedding and label; further columns are ignored.
    Vectors link when their labels are equal and not null and their cosine in
    double precision is at least ``cosine``.  Rows that repeat a vec_id are vectors of their own.  A vector that is null, empty,
    zero, or holds a null or non-finite component, and a row without vec_id,
    links with nothing; the latter has no component.  Vectors of different
    length never link.  Equal vectors, told by 128 bits of hash, are one vertex with a count, never all
    pairs.  Rotations are fitted on at most ``fit_rows`` rows, taken by a hash
    of the vector; every vector is indexed.  An empty table gives none.
    """
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(F.col("vec"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    mark = [F.xxhash64("label", "embedding").alias("v"), F.xxhash64(F.lit(1), "label", "embedding").alias("v2")]
    base = rows.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), F.struct(*mark, F.col("embedding").alias("vec"), "label")).alias("r"))
    base = base.select("vec_id", F.col("r.v").alias("mark"), "r.v2", "r.vec", "r.label").withColumn("norm", norm)
    base = base.withColumn("mark", F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("mark")))
    found = base.where("mark is not null").groupBy("mark", "v2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label"), F.first("norm").alias("norm"))
    classes = told_apart(keep(found.withColumn("v", F.col("mark")), "classes"))

    n = classes.count()
    at_least = min(1.0, max(-1.0, cosine))
    # About twice the bound pass, so that no more than that reaches the driver from all tasks.
    few = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, 2 * fit_rows / max(n, 1)) * (1 << 30))
    sample = [list(map(float, r["vec"])) for r in classes.where(few).select("v", "vec").orderBy("v").limit(fit_rows).select("vec").collect()]
    units = {}
    for dim in sorted({len(x) for x in sample}):
        x = np.array([y for y in sample if len(y) == dim])
        units[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    centred, width, tables, agree = plan(n, list(units.values()), at_least, miss)
    models, starts = {}, 1
    for dim, x in units.items():
        starts = math.ceil(tables * width / min(64, dim))
        models[dim] = learn(x, 64, starts, centred)

    coded = keep(classes.select("v", F.xxhash64("label", F.size("vec")).alias("kind"), "vec").mapInPandas(_encode(models, width, tables, starts), "v long, kind long, code long, keys array<int>"), "coded")
    slots = coded.select("v", "code", "kind", F.posexplode("keys").alias("t", "k")).select("v", "code", "t", F.xxhash64("kind", "t", "k").alias("bucket"))
    dense = keep(slots.where(f"pmod(xxhash64(v), {PROBE}) = 0").groupBy("bucket").agg(F.count("*").alias("n")).where(f"n > {DENSE // PROBE}").select("bucket", F.ceil(F.col("n") * PROBE / BLOCK).alias("blocks")), "dense")
    few_only = dense.isEmpty()
    sparse = slots if few_only else slots.join(dense, "bucket", "left_anti").select(*slots.columns)
    # The first 64 bits of a pair at 0.93 differ in 8 on average, with deviation 2.6, where vectors have no direction in common.
    flips = 64 * (1 - float(np.quantile(agree, 0.001)))
    near = int(flips + 5.5 * math.sqrt(flips * (1 - flips / 64)))
    # The code holds the substrings of the first tables: pairs that agree in one of them are theirs.
    later = [f"(a.t <= {j} or (shiftrightunsigned(a.code ^ b.code, {j * width}) & {(1 << width) - 1}L) <> 0)" for j in range(min(tables, 64 // width))]
    # Both sides are one plain exchange, which adaptive execution splits where a bucket is large.
    a, b = sparse.alias("a"), sparse.alias("b")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.v") < F.col("b.v")) & F.expr(" and ".join([f"bit_count(a.code ^ b.code) <= {near}", *later])))
    pairs = pairs.select(F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.col("a.t").alias("t"))
    whole = classes.join(coded.select("v", "keys"), "v").select("v", "vec", "norm", "label", "copies", "keys")
    at = lambda s: whole.select(*[F.col(c).alias(f"{c}_{s}" if c != "v" else s) for c in whole.columns])
    links = pairs.join(at("a"), "a").join(at("b"), "b").where((F.col("label_a") == F.col("label_b")) & (F.size("vec_a") == F.size("vec_b")) & (_cosine() >= cosine))
    links = links.where(F.array_position(F.zip_with("keys_a", "keys_b", lambda x, y: x == y), F.lit(True)) == F.col("t") + 1)
    links = keep(links.select("a", "b", "copies_a", "copies_b"), "links")
    ends = links.select(F.col("a").alias("v"), F.col("copies_b").alias("m")).unionByName(links.select(F.col("b").alias("v"), F.col("copies_a").alias("m")))
    links = links.select("a", "b")
    if not few_only:
        held = slots.join(dense, "bucket").select("bucket", "v", "t", "blocks")
        held = held.withColumn("own", F.expr("pmod(xxhash64(v, 7), blocks)")).withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)")))
        held = held.select("bucket", "v", "t", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
        held = held.join(whole.withColumn("label", F.col("label").cast("string")), "v")
        counted = keep(held.groupBy("bucket", "i", "j").applyInPandas(_blocks(cosine), "a long, b long, m long"), "counted")
        ends = ends.unionByName(counted.where("b is null").select(F.col("a").alias("v"), "m"))
        links = links.unionByName(counted.where("b is not null").select("a", "b"))
    others = ends.groupBy("v").agg(F.sum("m").alias("others"))
    comp = connected_components(links)
    low = classes.join(comp, classes["v"] == comp["id"]).select("v", "component", "first_id")
    low = low.join(low.groupBy("component").agg(F.min("first_id").alias("low")), "component").select("v", "low")
    label = classes.select("v", "mark", "v2", "copies", "first_id").join(others, "v", "left").join(low, "v", "left")
    label = keep(label.select("mark", "v2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("low", "first_id").alias("low")), "label")
    return (base.select("vec_id", "mark", "v2").join(label, ["mark", "v2"], "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _cosine() -> Column:
    dot = F.aggregate(F.zip_with("vec_a", "vec_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (F.col("norm_a") * F.col("norm_b"))


def _blocks(cosine: float):
    """Links between two blocks of a bucket, or within one, of pairs that agree in no earlier table.

    Rows with b are edges of a spanning forest; rows without say that links of a reach m further vectors.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table, same = int(pdf["t"].iloc[0]), bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
        out = [np.zeros((3, 0), np.int64)]
        for _, part in pdf.groupby([pdf["label"], pdf["vec"].map(len)], sort=False):
            part = part.drop_duplicates("v")
            left = part if same else part[part["own"] == part["i"]]
            right = part if same else part[part["own"] == part["j"]]
            if not len(left) or not len(right):
                continue
            x, y = (np.array(p["vec"].tolist(), np.float64) for p in (left, right))
            norms = np.outer(left["norm"], right["norm"])
            value = x @ y.T / norms
            link = value >= cosine
            for p, q in np.argwhere(np.abs(value - cosine) < 1e-9):  # summed in order, as for all other pairs
                link[p, q] = np.cumsum(x[p] * y[q])[-1] / norms[p, q] >= cosine
            if same:
                np.fill_diagonal(link, False)
            kx, ky = (np.array(p["keys"].tolist(), np.int32) for p in (left, right))
            for t in range(table):
                if not link.any():
                    break
                link &= kx[:, None, t] != ky[None, :, t]
            vx, vy = left["v"].to_numpy(np.int64), right["v"].to_numpy(np.int64)
            counts = [(vx, link @ right["copies"].to_numpy(np.int64))]
            if not same:
                counts.append((vy, left["copies"].to_numpy(np.int64) @ link))
            out += [np.stack([v[m > 0], np.full(int((m > 0).sum()), -1), m[m > 0]]) for v, m in counts]
            a, b = _forest(link, same)
            v = vx if same else np.concatenate([vx, vy])
            out.append(np.stack([v[a], v[b], np.full(len(a), -1)]))
        a, b, m = np.concatenate(out, axis=1)
        edge = m < 0
        edge = m < 0
        return pd.DataFrame({"a": a, "b": pd.Series(b, dtype="Int64").where(edge), "m": pd.Series(m, dtype="Int64").where(~edge)})
    return run


def _forest(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of rows, then columns if these are others) that join the same components as ``link``."""
    off = 0 if same else len(link)
    comp = np.arange(link.shape[1] + off)
    for x in np.flatnonzero(link.any(axis=1)):
        met = comp[np.flatnonzero(link[x]) + off]
        if (met != comp[x]).any():
            comp[np.isin(comp, met)] = comp[x]
    moved = np.flatnonzero(comp != np.arange(len(comp)))
    return moved, comp[moved]
