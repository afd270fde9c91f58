"""Queries through files: the record data source, resumed archives, completeness of reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.operators.sweep import sweep
from foldlattice.plans.motif import motif_sql
from foldlattice.queries.motifs import GEOM, MOTIFS, TOPO
from foldlattice.queries.texts import _labelled
from foldlattice.sources import archive, metamatrix
from foldlattice.sources.record_source import read_records
from foldlattice.streaming.completeness import completed_by_files
from foldlattice.streaming.sweep import shared_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("record_source", GEOM + "SELECT CAST(e.record_id AS VARCHAR) AS record_id, e.pos, e.etype, e.chain, e.length, coalesce(string_agg(c.code, '' ORDER BY c.j), '') AS codes FROM el1 e LEFT JOIN ct1 c ON c.record_id = e.record_id AND c.i = e.pos GROUP BY ALL")
def record_source(spark, sf_dir):
    """Records written as text and read through the data source in splits smaller than a file."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    metamatrix.write(_labelled(X.geometric(spark, sf_dir)), path, 4)
    back = read_records(spark, path, split=64 << 10).where("n >= 5")
    return back.select("record_id", F.posexplode(F.arrays_zip("elements", "rows")).alias("p", "x")).select("record_id", (F.col("p") + 1).alias("pos"), "x.elements.etype", "x.elements.chain", "x.elements.length", F.expr("substring(x.rows, 2)").alias("codes"))


ARCHIVED, CHUNKS, SHARDS = ("t2", "t3", "t4", "t3_any"), 8, 3


@query("resumed_archive", TOPO + " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(MOTIFS[m], 'el2', 'ct2')})" for m in ARCHIVED))
def resumed_archive(spark, sf_dir):
    """A search that loses about a third of its units at first and is resumed; equals the plain search."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    motifs = [MOTIFS[m] for m in ARCHIVED]
    records = X.topological(spark, sf_dir)
    chunk = F.pmod("record_id", F.lit(CHUNKS)).cast("int")
    wanted = archive.wanted_parts(spark.createDataFrame([(m.motif_id,) for m in motifs], "query_id string"), CHUNKS)
    # a unit that fails has lost half of its rows
    fails = F.pmod(F.xxhash64(F.pmod(F.xxhash64("query_id"), F.lit(SHARDS)), "chunk"), F.lit(3)) == 0
    found = sweep(records, motifs).withColumn("chunk", chunk)
    archive.write_attempt(found.where(~fails | (F.col("record_id") % 2 == 0)), wanted.withColumn("rc", fails.cast("int")), path, SHARDS)
    left = archive.pending(spark, path, wanted, SHARDS)
    if left.limit(1).count():
        try:
            archive.finished(spark, path, wanted)
        except archive.ArchiveError:
            pass
        else:
            raise AssertionError("an archive with missing parts was taken for whole")
        open_motifs, open_chunks = ({r[0] for r in left.select(c).distinct().collect()} for c in ("query_id", "chunk"))
        again = sweep(records.where(chunk.isin(sorted(open_chunks))), [m for m in motifs if m.motif_id in open_motifs]).withColumn("chunk", chunk)
        archive.write_attempt(again.join(left, ["query_id", "chunk"], "left_semi"), left.withColumn("rc", F.lit(0)), path, SHARDS)
    return archive.finished(spark, path, wanted).select("query_id", "record_id", "positions")


_PARTS = 4


@query("completed_queries", f"""WITH p AS (SELECT o_custkey AS query_id, CAST(o_orderkey % {_PARTS} AS INTEGER) AS chunk FROM orders WHERE o_orderstatus <> 'P')
SELECT query_id, CAST({_PARTS} AS INTEGER) AS chunks, CAST(sum(query_id % 100 + chunk) AS BIGINT) AS rows FROM (SELECT DISTINCT query_id, chunk FROM p) GROUP BY query_id HAVING count(*) = {_PARTS}""")
def completed_queries_of_orders(spark, sf_dir):
    """Customers all of whose chunks of orders have come in; open orders failed, repeated chunks do nothing."""
    rows = (F.col("o_custkey") % 100 + F.col("o_orderkey") % _PARTS).cast("long")
    parts = X.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % _PARTS).cast("int").alias("chunk"), (F.col("o_orderstatus") == "P").cast("int").alias("rc"), rows.alias("rows"))
    return completed_by_files(parts, _PARTS, files=5)
