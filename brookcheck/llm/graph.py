"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id that edges reach.

    Two steps alternate until every component is a star.  In the large star each
    vertex hangs its larger neighbours on the smallest id it knows; in the small
    star its smaller ones and itself.  Minima are pre-aggregated before the
    shuffle and written, so that the join back to the edges reads two plain
    exchanges, which adaptive execution splits when one vertex has a great share
    of the edges.  Loops over one vertex and edges with a null end link nothing.
    """
    e = keep(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        drop(low)
        low = keep(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        new = keep(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for x in (e, large, low):
            drop(x)
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """No vertex hangs on two, or hangs and is hung on."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("id").agg((F.sum("up") + F.max("root")).alias("k")).where("k > 1").isEmpty()
