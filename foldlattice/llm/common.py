"""Reading document tables, shared-folder tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a local session may leave it unset and gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends here, and a
    lost executor costs no more than rereading files."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of ``ARROW_ROWS`` rows at most, so that long texts make no large ones; the session keeps that setting."""
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_SETTING)) > ARROW_ROWS:
        conf.set(ARROW_SETTING, ARROW_ROWS)
    return df.mapInArrow(work, schema)


def training_hash(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node of an edge list (``a`` long, ``b`` long): ``node, root``.

    Alternating star contraction: hubs are contracted by a minimum and a join, so no group is
    ever gathered, and the number of rounds grows with the logarithm of the longest chain.
    Rounds end as soon as all edges are stars around their smallest ids, so pairs need none.
    Nodes without an edge don't appear; loops and repeats are harmless.
    """

    def stars(links: DataFrame) -> bool:
        """No node has two edges to smaller ones, or one to and one from it."""
        ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not nodes.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0]

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def named(name: str) -> Column:
    """The column of exactly that name, dots and backquotes included."""
    return F.col(f"`{name.replace('`', '``')}`")


def join_totals(rows: DataFrame, totals: DataFrame, key: str, held: str, share: int = 1000) -> DataFrame:
    """``rows`` with the figures of ``totals``, one row a value of ``key`` (nulls together) that counts its rows in ``held``.

    Values that hold more than a ``share``-th of all rows are fewer than ``share``, so their figures are
    broadcast; the rest is joined by key, and no value of it brings a task more than that part.
    """
    totals = stored(totals.withColumnRenamed(key, "__key"), "totals")
    everything = totals.agg(F.sum(held)).first()[0] or 0
    same = F.col(key).eqNullSafe(F.col("__key"))
    hot, rare = F.broadcast(totals.where(F.col(held) * share > everything)), totals.where(F.col(held) * share <= everything)
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(rare, same)).drop("__key", held)


def by_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Deal rows out by integer ``keys`` and hand ``work`` runs of whole groups.

    ``parts`` is the number of tasks where the caller knows how many groups of bounded size there are.

    ``work(rows, bounds)`` gets rows sorted by the keys; group i is ``bounds[i]:bounds[i + 1]``.
    Many small groups cost one call.  The caller sees to it that one group stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if open_rows is None else pa.concat_tables([open_rows, rows])).combine_chunks()
            if not len(rows):
                continue
            differs = np.zeros(len(rows), dtype=bool)
            for k in keys:
                x = rows[k].to_numpy()
                differs[1:] |= x[1:] != x[:-1]
            starts = np.concatenate(([0], np.flatnonzero(differs)))
            open_rows = rows.slice(starts[-1])
            if len(starts) > 1:
                yield from work(rows.slice(0, starts[-1]), starts)
        if open_rows is not None and len(open_rows):
            yield from work(open_rows, np.array([0, len(open_rows)]))

    dealt = df.repartition(*keys) if parts is None else df.repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys).transform(in_arrow, run, schema)
