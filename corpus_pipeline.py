"""The training-data pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookcheck.llm import decontaminate, language, mixing, near_dedup, pii
from brookcheck.llm.common import drop, fresh, keep, table


#: Lists of ids of up to this many are broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of the ids in the table ``gone``; rows without doc_id stay."""
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter or look like no language that was learned.

    Repeated rows, and rows without doc_id, are judged each; columns of any name stay.
    An empty table stays empty; without a labelled row nothing was learned and everything is rejected.
    """
    net = language.calibrate(docs, language.train(docs))
    lang, score = fresh("_lang", docs.columns), fresh("_score", docs.columns)
    found = language.predict(docs, net, lang, score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= net.least)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group; rows without doc_id stay, rows equal in id and text become one.

    Rows that repeat an id with another text share its fate.  Empty tables stay empty, and columns of any name stay.
    """
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    left = _without(docs, keep(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    twice = keep(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    # Only rows of ids that occur more than once are dealt out by id and text.
    again = left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return _without(left, twice).unionByName(again)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item; rows that repeat an id go together, rows without one stay.

    Null and empty texts hold nothing; an empty table, or benchmark, removes nothing.  Columns of any name stay.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, keep(found.select("doc_id").distinct(), "gone"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts; all rows and columns stay, null texts as they are."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("pii", sanitise),
    ("mix", mix),
]

#: Language identification is trained, so SQL cannot state the rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
