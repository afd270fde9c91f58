"""Statistical operators over DataFrames; only log-gamma sums leave built-in functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def bh_adjust(rows: DataFrame, p: str = "p", name: str = "q", within: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    Tests are a summary (a row a cell), so ranking them within a family in one window is meant.
    """
    family = W.partitionBy(*(within or [F.lit(0)]))
    ranked = rows.withColumn("_rank", F.row_number().over(family.orderBy(p))).withColumn("_all", F.count("*").over(family))
    raw = F.col(p) * F.col("_all") / F.col("_rank")
    down = family.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(raw).over(down))).drop("_rank", "_all")


def poisson_binomial_cdf(shares: Column, at_most: Column) -> Column:
    """P(X <= at_most) for independent trials with probabilities ``shares`` (an array), by convolution."""
    start = F.array(F.lit(1.0))
    grown = F.aggregate(
        shares,
        start,
        lambda d, p: F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda stay, step: stay * (1 - p) + step * p),
    )
    return F.aggregate(F.slice(grown, F.lit(1), F.least(at_most + 1, F.size(grown))), F.lit(0.0), lambda a, x: a + x)


def _convolved(a: Column, b: Column, most: int) -> Column:
    """Product of two distributions of counts, up to the count ``most``."""
    places = F.sequence(F.lit(0), F.least(F.lit(most), F.size(a) + F.size(b) - 2))

    def at(s: Column) -> Column:
        both = F.sequence(F.greatest(F.lit(0), s - F.size(b) + 1), F.least(s, F.size(a) - 1))
        return F.aggregate(both, F.lit(0.0), lambda acc, i: acc + F.get(a, i) * F.get(b, s - i))

    return F.transform(places, at)


def poisson_binomial(rows: DataFrame, by: list[str], share: str, most: int, piece: int = 256, fan: int = 16) -> DataFrame:
    """``by, chances``: P(X = 0) to P(X = most) of the hits among each group's independent trials.

    Rows that lie together make pieces of at most ``piece`` trials, whose truncated distributions are found
    where they lie; then distributions are multiplied ``fan`` or so at a time until a group has one.  So
    a group may span any number of tasks, and what moves is ``most`` + 1 numbers a piece.  Null shares are no
    trials; a group of only those has no row.
    """
    own = rows.where(F.col(share).isNotNull()).select(*by, F.col(share).cast("double").alias("p"), F.expr(f"monotonically_increasing_id() div {piece}").alias("part"))
    listed = own.groupBy(*by, "part").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # ``piece`` trials at most
    one = F.aggregate("ps", F.array(F.lit(1.0)), lambda d, p: F.slice(F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda stay, step: stay * (1 - p) + step * p), 1, most + 1))
    now = listed.select(*by, "part", one.alias("chances"))
    pieces = now.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while pieces > 1:
        slots = -(-pieces // fan)
        met = now.groupBy(*by, F.pmod(F.xxhash64("part"), F.lit(slots)).alias("part")).agg(F.array_sort(F.collect_list("chances")).alias("all"))
        now = met.select(*by, "part", F.aggregate("all", F.array(F.lit(1.0)), lambda a, b: _convolved(a, b, most)).alias("chances"))
        pieces = slots if slots > 1 else 1
    return now.select(*by, "chances")


def at_most(chances: Column) -> Column:
    """Sum of a list of chances."""
    return F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)


def no_hit_probability(p: str) -> Column:
    """Product of 1 - p over a group; 0 where a p is 1, whose logarithm would be null."""
    return F.when(F.max(p) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.lit(1.0) - F.col(p)))))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    pooled = (x1 + x2) / (n1 + n2)
    return (x1 / n1 - x2 / n2) / F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))


def sign_test_z(plus: Column, minus: Column) -> Column:
    return (plus - minus) / F.sqrt(plus + minus)


def mann_whitney(rows: DataFrame, value: str, is_first: Column, by: list[str]) -> DataFrame:
    """``by, n1, n2, u, z`` of the first group against the rest; ties share their mean rank.

    Ranks come from counts of distinct values, so equal values never gather.
    """
    counts = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count_if(is_first).alias("a"), F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("v"))
    ranked = counts.withColumn("rank", upto - (F.col("n") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    n = F.col("n1") + F.col("n2")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return sums.select(*by, "n1", "n2", u.alias("u"), ((u - F.col("n1") * F.col("n2") / 2.0) / spread).alias("z"))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: tables no likelier than the one seen."""
    n, row, col = a + b + c + d, a + b, a + c
    whole = _log_choose(n, row)
    logs = [_log_choose(col, k) + _log_choose(n - col, row - k) - whole for k in range(max(0, row + col - n), min(row, col) + 1)]
    seen = _log_choose(col, a) + _log_choose(n - col, row - a) - whole
    return min(1.0, sum(math.exp(x) for x in logs if x <= seen + 1e-7))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Two-sided exact binomial p."""
    if not 0 < p < 1:
        return 1.0 if k == n * p else 0.0
    logs = [_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in logs if x <= logs[k] + 1e-7))


def fisher_exact(rows: DataFrame, a: str, b: str, c: str, d: str, name: str = "p") -> DataFrame:
    run = F.pandas_udf(lambda w, x, y, z: pd.Series([fisher_two_sided(*map(int, t)) for t in zip(w, x, y, z)], dtype=float), DoubleType())
    return rows.withColumn(name, run(a, b, c, d))


def binomial_test(rows: DataFrame, k: str, n: str, p: str, name: str = "p_binom", greater: bool = False) -> DataFrame:
    """Exact binomial p, two-sided or of ``k`` and more."""
    exact = binomial_greater if greater else binomial_two_sided
    run = F.pandas_udf(lambda x, y, z: pd.Series([exact(int(i), int(j), float(q)) for i, j, q in zip(x, y, z)], dtype=float), DoubleType())
    return rows.withColumn(name, run(k, n, p))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, from the error function's series of positive terms."""
    t = F.least(F.lit(6.0), F.greatest(F.lit(-6.0), x / math.sqrt(2)))
    start = F.struct(t.alias("term"), t.alias("sum"), t.alias("t"))

    def grown(a: Column, n: Column) -> Column:
        term = a["term"] * 2 * a["t"] * a["t"] / (2 * n + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"), a["t"].alias("t"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, grown, lambda a: 0.5 * (1 + 2 / math.sqrt(math.pi) * F.exp(-a["t"] * a["t"]) * a["sum"]))


def binomial_greater(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if not 0 < p < 1:
        return float(p == 1)
    return min(1.0, sum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def exact_samples(rows: DataFrame, h: Column, most: int, tie: Column, sizes: list[int], within: list[str], buckets: int = 4096) -> DataFrame:
    """The columns of ``rows`` and ``size``: for each ``within`` exactly the ``size`` rows of least hash, all where there are fewer.

    ``h`` lies from 0 below ``most``; equal hashes are told apart by ``tie``.  Samples of one ``within`` are
    nested.  Counts by ranges of the hash, a partial aggregate, tell in which range a sample ends; only rows
    of that range, about one in ``buckets``, are ranked.
    """
    own = rows.withColumns({"_h": h, "_tie": tie}).withColumn("_b", F.floor(F.col("_h") * buckets / most))
    counts = own.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*within).orderBy("_b")))
    sized = upto.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    ends = sized.where(F.col("_upto") >= F.col("size")).groupBy(*within, "size").agg(F.min(F.struct("_b", (F.col("size") - F.col("_upto") + F.col("_n")).alias("left"))).alias("e"))
    wanted = counts.select(*within).distinct().select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    # a row a sample; past the last range where there are too few rows
    cuts = wanted.join(ends, [*within, "size"], "left").select(*within, "size", F.coalesce("e._b", F.lit(buckets)).alias("_end"), F.coalesce("e.left", F.lit(0)).alias("_left"))
    held = own.join(cuts, within).where("_b <= _end")
    rank = F.row_number().over(W.partitionBy(*within, "size").orderBy("_h", "_tie"))
    edge = held.where("_b = _end").withColumn("_rank", rank).where("_rank <= _left").drop("_rank")
    return held.where("_b < _end").unionByName(edge).drop("_h", "_tie", "_b", "_end", "_left")


def hash_share(key: Column, salt: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 1) of an integer key, the same in any engine."""
    return F.pmod((key + salt) * 2654435761, F.lit(1_000_003)) / 1_000_003.0
