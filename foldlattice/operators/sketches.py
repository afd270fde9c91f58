"""Theta sketches of distinct items by cell, source and part: stored once, merged without the hits.

A part's sketch is a value of bounded size whatever the number of items, so a later question (whole
cells, sources, what two sources share) reads sketches alone, and a new part adds its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of a sketch's entries; its relative standard error is 2 ** (-LOG / 2), and counts below 2 ** LOG are exact.
LOG = 12
#: Relative error that an estimate keeps but for about one case in a thousand; of an intersection, a share of the union.
BOUND = 3.3 * 2 ** (-LOG / 2)


def store_sketches(hits: DataFrame, by: list[str], part: str, item: str, path: str) -> None:
    """Write ``by, sketch`` partitioned by ``part`` under ``path``; a part that is written again replaces its own."""
    made = hits.groupBy(*by, part).agg(F.theta_sketch_agg(item, LOG).alias("sketch"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def merged(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """``by, sketch`` over all parts and all other columns."""
    return spark.read.parquet(path).groupBy(*by).agg(F.theta_union_agg("sketch", LOG).alias("sketch"))


def shared(spark: SparkSession, path: str, by: list[str], side: str, first: str, second: str) -> DataFrame:
    """``by, first, second, both, either``: estimated items of two values of ``side`` and what they share."""
    own = merged(spark, path, [*by, side]).where(F.col(side).isin(first, second))
    wide = own.groupBy(*by).agg(*[F.first(F.when(F.col(side) == v, F.col("sketch")), ignorenulls=True).alias(n) for v, n in ((first, "a"), (second, "b"))])
    size = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0))
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.theta_sketch_estimate(F.theta_intersection("a", "b"))).otherwise(0)
    either = F.theta_sketch_estimate(F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.theta_union("a", "b", LOG)))
    return wide.select(*by, size(F.col("a")).alias("first"), size(F.col("b")).alias("second"), both.alias("both"), either.alias("either"))
