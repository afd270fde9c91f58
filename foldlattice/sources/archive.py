"""Hit tables as checked archives."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


class ArchiveError(RuntimeError):
    """An archive that doesn't hold what was written."""


def missing(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id`` of queries that were to be searched and are not in ``hits``."""
    return wanted.select("query_id").distinct().join(hits.select("query_id"), "query_id", "left_anti")


def write_archive(hits: DataFrame, path: str, shards: int) -> int:
    """Write hits (query_id, record_id, ...) under ``path`` by shards of queries, read them back and return their number.

    Spark's commit makes a half-written archive invisible; a count that differs afterwards is an error.
    """
    dealt = hits.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int"))
    wanted = dealt.count()
    dealt.repartition("shard", F.pmod(F.xxhash64("record_id"), F.lit(16))).write.partitionBy("shard").parquet(path)
    held = hits.sparkSession.read.parquet(path).count() if wanted else 0
    if held != wanted:
        raise ArchiveError(f"{path}: {held} rows of {wanted}")
    return held


def query_counts(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, records, hits`` of an archive."""
    return spark.read.parquet(path).groupBy("query_id").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("hits"))


def distinct_hitters(spark: SparkSession, path: str) -> DataFrame:
    """``record_id`` of every record with a hit."""
    return spark.read.parquet(path).select("record_id").distinct()


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")


def wanted_parts(queries: DataFrame, chunks: int) -> DataFrame:
    """``query_id, chunk``: every query in every chunk."""
    return queries.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))


def write_attempt(hits: DataFrame, outcomes: DataFrame, path: str, shards: int) -> None:
    """Add one attempt's hits (query_id, chunk, ...) and its return codes (query_id, chunk, rc) to a resumable archive.

    The unit is a shard of queries in a chunk: an attempt brings whole units and replaces those alone.  Hits
    carry the attempt's mark and the ledger is written after them with the rows read back, so what a
    broken attempt leaves is never taken for its successor's.  A unit with many hits is written by several tasks.
    """
    spark, run = hits.sparkSession, uuid.uuid4().hex

    def put(rows: DataFrame, name: str) -> None:
        dealt = rows.withColumns({"shard": _shard(shards), "run": F.lit(run)})
        dealt.hint("rebalance", "shard", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "chunk").parquet(f"{path}/{name}")

    put(hits, "hits")
    held = _stored(spark, path, "hits", hits).where(F.col("run") == run).groupBy("query_id", "chunk").agg(F.count("*").alias("rows"))
    put(outcomes.join(held, ["query_id", "chunk"], "left").select("query_id", "chunk", "rc", F.coalesce("rows", F.lit(0)).cast("long").alias("rows")), "ledger")


def _stored(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    """What is stored so far; nothing, in the same columns, before the first file."""
    schema = StructType([*[f for f in like.schema.fields if f.name != "chunk"], StructField("run", StringType()), StructField("shard", IntegerType()), StructField("chunk", like.schema["chunk"].dataType)])
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, chunk, rc, rows, run, shard`` of the last attempt at each part."""
    return spark.read.parquet(f"{path}/ledger")


def pending(spark: SparkSession, path: str, wanted: DataFrame, shards: int) -> DataFrame:
    """``query_id, chunk`` that are to be run (again): all queries of every unit with a part that is missing or failed."""
    done = ledger(spark, path).where("rc = 0").select("query_id", "chunk")
    dealt = wanted.withColumn("shard", _shard(shards))
    units = dealt.join(done, ["query_id", "chunk"], "left_anti").select("shard", "chunk").distinct()
    return dealt.join(units, ["shard", "chunk"], "left_semi").select("query_id", "chunk")


def finished(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The hits of a complete archive; an error while a part is missing or holds other rows than its ledger says."""
    parts = ledger(spark, path).where("rc = 0")
    lacking = wanted.join(parts, ["query_id", "chunk"], "left_anti").count()
    if lacking:
        raise ArchiveError(f"{path}: {lacking} parts are missing")
    hits = spark.read.parquet(f"{path}/hits").join(parts.select("query_id", "chunk", "run"), ["query_id", "chunk", "run"], "left_semi")
    counts = hits.groupBy("query_id", "chunk").agg(F.count("*").alias("held"))
    broken = parts.join(counts, ["query_id", "chunk"], "left").where("rows <> coalesce(held, 0)").count()
    if broken:
        raise ArchiveError(f"{path}: {broken} parts hold other rows than were written")
    return hits.drop("run", "shard")
