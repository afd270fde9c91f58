"""Motif search over record chunks that arrive as files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.operators.search import search
from foldlattice.plans.motif import Motif


def shared_folder(spark) -> str:
    """The folder that all executors see; a local session may leave it unset and gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="stream-")).rstrip("/")


def write_dealt(rows: DataFrame, path: str, batches: int) -> int:
    """Write rows as Parquet without a shuffle, each task's dealt out to ``batches`` folders.

    Returns how many of the files make one of about ``batches`` equal parts; none where there are no rows.
    """
    rows.withColumn("dealt", (F.monotonically_increasing_id() % batches).cast("int")).write.partitionBy("dealt").parquet(path)
    return -(-len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles()) // batches)


def sweep_stream(records: DataFrame, motif: Motif, out: str, checkpoint: str):
    """A streaming query that appends each micro-batch's hits to Parquet.

    A record is whole within its batch and a match never spans records, so batches need no state;
    the sink's log makes a repeated batch replace itself.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        search(batch, motif).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep_chunks(records: DataFrame, motif: Motif, chunks: int) -> DataFrame:
    """Write records as files, read them as a stream in about ``chunks`` batches, and return all hits."""
    spark = records.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    a_batch = write_dealt(records, f"{folder}/in", chunks)
    if not a_batch:
        return search(records, motif)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", a_batch).parquet(f"{folder}/in").select(records.columns)
    sweep_stream(stream, motif, f"{folder}/out", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("epoch")
