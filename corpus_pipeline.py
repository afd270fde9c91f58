"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``, whatever their names.  Rows without an id are dropped by the
joins on ids; rows that share an id pass the quality rules together, and of those that share their text
too, one is left behind the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import named, stored, table
from foldlattice.llm.dedup import near_duplicates
from foldlattice.llm.packing import pack
from foldlattice.llm.quality_classifier import quality_classifier
from foldlattice.llm.quality_rules import quality_rules
from foldlattice.llm.registry import VOCABULARY


#: Text pieces that a packing worker remembers; other stages' workers need their memory too.
REMEMBERED = 150_000
#: Percent of shared word shingles from which documents are near duplicates.
SIMILARITY = 80


def _columns(docs: DataFrame) -> list:
    """All columns of ``docs``, whatever their names."""
    return [named(c) for c in docs.columns]


def _unused(docs: DataFrame, name: str) -> str:
    """``name`` behind so many underscores that no column of ``docs`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = f"_{name}"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    prefix = _unused(docs, "judged_")
    return quality_classifier(docs, table(spark, sf_dir, "labels"), prefix=prefix).where(named(f"{prefix}kept")).select(*_columns(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return docs.join(quality_rules(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*_columns(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component; linked are texts of a similarity of ``SIMILARITY`` percent or more."""
    kept = docs.join(near_duplicates(docs, percent=SIMILARITY).where("kept").select("doc_id"), "doc_id", "left_semi")
    same, copy = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"), _unused(docs, "copy")
    return kept.withColumn(copy, F.row_number().over(same)).where(named(copy) == 1).select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences."""
    return pack(docs, VOCABULARY, end_id=0, remembered=REMEMBERED).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_duplicates", deduplicate), ("packing", pack_sequences)]
#: SQL cannot express the stages; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
