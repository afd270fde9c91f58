"""Adapters that present general tables as structure records.

``topological``: an order's lines are elements whose codes follow from part keys.
``geometric``: a vector's components are ten element axes whose codes follow from geometry.
Both give one row a record: ``record_id, n, elements, rows, sheets``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlattice.functions import geometry as G

#: Codes by the sum of part keys modulo eight.
KEY_CODES = "--uvNct-"
_LETTERS = "abcdefghABCDEFGH"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores dealt out, as each one's work is large; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, one shuffle of the needed columns."""
    line = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    return _of_lines(read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.sort_array(F.collect_list(line)).alias("lines")))  # an order's lines are few


def long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: the lines of all of a customer's orders by date, tens of elements each."""
    line = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    return _of_lines(lines.groupBy(F.col("o_custkey").alias("record_id")).agg(F.sort_array(F.collect_list(line)).alias("lines")))


def _letter_codes() -> list[str]:
    """For each letter its codes with all letters; strands alone are bonded."""
    codes = [[KEY_CODES[(a + b) % 8] for b in range(16)] for a in range(16)]
    return ["".join("-" if c in "ct" and min(a, b) < 8 else c for b, c in enumerate(row)) for a, row in enumerate(codes)]


def _of_lines(grouped: DataFrame) -> DataFrame:
    etype = "translate(x.l_returnflag, 'ARN', 'HEL')"
    elements = f"transform(lines, (x, i) -> named_struct('etype', {etype}, 'chain', x.l_linestatus, 'length', cast(x.l_quantity as int), 'key', x.l_partkey))"
    # an element as a letter: its key modulo eight, and whether it is a strand; a row translates the letters behind its own
    letter = f"coalesce(substring('{_LETTERS}', cast(pmod(e.key, 8) as int) + CASE WHEN e.etype = 'E' THEN 9 ELSE 1 END, 1), '-')"
    row = f"concat('*', translate(substring(k, i + 2), '{_LETTERS}', coalesce(get(array({', '.join(map(repr, _letter_codes()))}), instr('{_LETTERS}', substring(k, i + 1, 1)) - 1), '{'-' * len(_LETTERS)}')))"
    rows = f"element_at(transform(array(array_join(transform(elements, e -> {letter}), '')), k -> transform(elements, (a, i) -> {row})), 1)"
    return grouped.select("record_id", F.size("lines").alias("n"), F.expr(elements).alias("elements")).select("record_id", "n", "elements", F.expr(rows).alias("rows"), F.expr("cast(array() as array<array<int>>)").alias("sheets"))


def geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as records of ten axes; no shuffle but where the table has fewer splits than cores."""
    points = "transform(sequence(0, 9), i -> named_struct(" + ", ".join(f"'{e}{k}', cast(embedding[6 * i + {3 * s + d}] as double) * 40e0" for s, e in enumerate("fl") for d, k in enumerate("xyz")) + "))"
    size = G.length("x")
    element = f"named_struct('etype', CASE WHEN {size} > 11e0 THEN 'H' ELSE 'E' END, 'chain', CASE WHEN record_id % 3 = 0 AND i >= 5 THEN 'B' ELSE 'A' END, 'length', cast(floor({size}) as int), 'fx', x.fx, 'fy', x.fy, 'fz', x.fz, 'lx', x.lx, 'ly', x.ly, 'lz', x.lz)"
    base = spread(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select(F.col("vec_id").alias("record_id"), F.col("label").alias("fold"), "embedding")
    base = base.select("record_id", "fold", F.expr(points).alias("points")).select("record_id", "fold", F.expr(f"transform(points, (x, i) -> {element})").alias("elements"))
    strands = "filter(sequence(1, 10), i -> element_at(elements, i).etype = 'E' AND i {} 5)"
    sheets = f"filter(array({strands.format('<=')}, {strands.format('>')}), s -> size(s) > 0)"
    return base.withColumn("sheets", F.expr(sheets)).withColumn("rows", F.expr(_geometric_rows())).select("record_id", "fold", F.lit(10).alias("n"), "elements", "rows", "sheets")


def pair_code(a: str, b: str, i: str, j: str, bind: bool = False) -> str:
    """Code of a geometric pair; strands next to each other in one half are bonded."""
    strands = f"({a}.etype = 'E' AND {b}.etype = 'E')"
    same = f"(({i} <= 5) = ({j} <= 5))"
    measures = {"gap": G.distance(a, b), "turn": G.angle(a, b)}
    return G.let(measures, lambda m: G.interaction_code(G.overlap(a, b, bind), m["gap"], m["turn"], strands, f"({strands} AND {same} AND {j} = {i} + 1)", same), bind, "q")


def _geometric_rows() -> str:
    return f"transform(elements, (a, i) -> concat('*', array_join(transform(slice(elements, i + 2, 10), (b, j) -> {pair_code('a', 'b', '(i + 1)', '(i + j + 2)', bind=True)}), '')))"


def elements_of(records: DataFrame) -> DataFrame:
    """One row an element, from 1."""
    return records.select("record_id", F.posexplode("elements").alias("pos", "e")).select("record_id", (F.col("pos") + 1).alias("pos"), "e.*")


def contacts_of(records: DataFrame) -> DataFrame:
    """One row a pair i < j with its code."""
    # outer: else a filter on the size of ``rows`` goes below and makes them a second time
    rows = records.select("record_id", F.posexplode_outer("rows").alias("i", "row")).where(F.length("row") > 1)
    return rows.select("record_id", (F.col("i") + 1).alias("i"), F.posexplode(F.split(F.expr("substring(row, 2)"), "")).alias("d", "code")).where("code <> ''").select("record_id", "i", (F.col("i") + F.col("d") + 1).alias("j"), "code")


#: The same adapters as SQL common table expressions, for comparison.
TOPOLOGICAL_SQL = """
el2 AS (
  SELECT l_orderkey AS record_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS pos,
    CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'R' THEN 'E' ELSE 'L' END AS etype, l_linestatus AS chain, CAST(l_quantity AS INTEGER) AS length, l_partkey AS key
  FROM lineitem),
ct2 AS (
  SELECT a.record_id, a.pos AS i, b.pos AS j,
    CASE WHEN (a.key + b.key) % 8 = 2 THEN 'u' WHEN (a.key + b.key) % 8 = 3 THEN 'v' WHEN (a.key + b.key) % 8 = 4 THEN 'N'
      WHEN (a.key + b.key) % 8 = 5 AND a.etype = 'E' AND b.etype = 'E' THEN 'c' WHEN (a.key + b.key) % 8 = 6 AND a.etype = 'E' AND b.etype = 'E' THEN 't' ELSE '-' END AS code
  FROM el2 a JOIN el2 b ON a.record_id = b.record_id AND a.pos < b.pos)"""

LONG_SQL = """
el3 AS (
  SELECT o_custkey AS record_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS pos,
    CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'R' THEN 'E' ELSE 'L' END AS etype, l_linestatus AS chain, CAST(l_quantity AS INTEGER) AS length, l_partkey AS key
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ct3 AS (
  SELECT a.record_id, a.pos AS i, b.pos AS j,
    CASE WHEN (a.key + b.key) % 8 = 2 THEN 'u' WHEN (a.key + b.key) % 8 = 3 THEN 'v' WHEN (a.key + b.key) % 8 = 4 THEN 'N'
      WHEN (a.key + b.key) % 8 = 5 AND a.etype = 'E' AND b.etype = 'E' THEN 'c' WHEN (a.key + b.key) % 8 = 6 AND a.etype = 'E' AND b.etype = 'E' THEN 't' ELSE '-' END AS code
  FROM el3 a JOIN el3 b ON a.record_id = b.record_id AND a.pos < b.pos)"""


def _geometric_sql() -> str:
    coords = ", ".join(f"CAST(embedding[6 * i + {3 * s + d + 1}] AS DOUBLE) * 40 AS {e}{k}" for s, e in enumerate("fl") for d, k in enumerate("xyz"))
    size = G.length("x")
    return f"""
pt1 AS (SELECT vec_id AS record_id, label AS fold, CAST(i + 1 AS INTEGER) AS pos, {coords} FROM embeddings, range(10) r(i)),
el1 AS (
  SELECT x.record_id, x.fold, x.pos, CASE WHEN {size} > 11 THEN 'H' ELSE 'E' END AS etype, CASE WHEN x.record_id % 3 = 0 AND x.pos >= 6 THEN 'B' ELSE 'A' END AS chain,
    CAST(floor({size}) AS INTEGER) AS length, x.fx, x.fy, x.fz, x.lx, x.ly, x.lz FROM pt1 x),
ct1 AS (SELECT a.record_id, a.pos AS i, b.pos AS j, {pair_code('a', 'b', 'a.pos', 'b.pos')} AS code FROM el1 a JOIN el1 b ON a.record_id = b.record_id AND a.pos < b.pos),
sh1 AS (SELECT record_id, CASE WHEN pos <= 5 THEN 1 ELSE 2 END AS sheet, pos FROM el1 WHERE etype = 'E')"""


GEOMETRIC_SQL = _geometric_sql()
