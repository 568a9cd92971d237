"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables that the operators now running have written, one list for each.
_written: list[list[DataFrame]] = []

#: A word is a run of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode one of our own where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="brookcheck-")
    return _OWN[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brookcheck/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _written:
        _written[-1].append(out)
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and nothing reads any more."""
    path, df._kept_at = getattr(df, "_kept_at", None), None
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and all other tables that it wrote deleted."""
    @functools.wraps(operator)
    def run(*args, **how) -> DataFrame:
        _written.append([])
        own = _written[-1]
        try:
            found = operator(*args, **how)
            _written.pop()
            out = keep(found, operator.__name__)
        finally:
            if _written and _written[-1] is own:
                _written.pop()
            for x in own:
                drop(x)
        return out
    return run


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with v alone telling fingerprints (v, v2) apart: of those that agree in v only, all but one get another v.

    Rows without v stay as they are.  Among 1e10 fingerprints about three pairs agree in 64 bits.
    """
    clash = keep(rows.where("v is not null").groupBy("v").agg(F.min("v2").alias("lo"), F.max("v2").alias("hi")).where("lo <> hi").select("v", "lo"), "clash")
    if clash.isEmpty():
        return rows
    v = F.when(F.col("v2") != F.col("lo"), F.xxhash64("v", "v2")).otherwise(F.col("v"))
    return rows.join(clash, "v", "left").withColumn("v", v).select(*rows.columns)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as tell it from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words of a text column as BIGINT; null text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- hashing of words in numpy, one document at a time ---------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C1B  # 3 mod 8
_INV = pow(_P, -1, 2**64)
_pow = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _pow["n"]:
        size = max(1 << 14, 1 << n.bit_length())
        for key, base in (("up", _P), ("down", _INV)):
            step = np.full(size + 1, base, np.uint64)
            step[0] = 1
            _pow[key] = np.cumprod(step, dtype=np.uint64)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(word))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """A uint64 for each word of a UTF-8 text; ``lower`` folds A-Z."""
    if not data:
        return np.zeros(0, np.uint64)
    start, end = word_bounds(data)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[np.frombuffer(data, np.uint8)] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one shingle as a whole."""
    if not len(words):
        return words
    size = min(size, len(words)) if len(words) < size else size
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out + words[k:k + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))
