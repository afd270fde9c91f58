"""Quality rules: text statistics by SQL functions, then robust multivariate outliers.

Statistics come from built-in functions only, one row a document and no shuffle of words.
Documents that pass the plain rules enter a minimum-covariance-determinant fit for each language
and source: concentration steps alternate between squared Mahalanobis distances and the moments of
the nearest ``share`` of the group.  Moments are partial aggregates, and quantiles come from counts
of fixed bins, so a source with a third of all rows is no single group.  Groups of fewer than
``least`` such documents are fitted together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import named, stored

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each transformed statistic.
FLOORS = (0.06, 0.06, 0.10, 0.10)
BIN = 0.005


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, ``extra`` and the counts of every whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines`` and
    ``n_repeat_words``.  A null text has no words.  A text's three-word windows are compared by their 64-bit hashes.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in extra], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blank = reduce(lambda c, b: F.replace(c, F.lit(b), F.lit(" ")), BLANKS, F.col("text"))
    one = own.withColumn("spaced", blank).select(
        "doc_id",
        *extra,
        F.array_remove(F.split("spaced", " "), "").alias("words"),
        (F.length("text") - F.octet_length("text") + F.octet_length(F.replace("spaced", F.lit(" "), F.lit("")))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n = F.size("words")
    zipped = F.arrays_zip(F.slice("words", F.lit(1), n - 2), F.slice("words", F.lit(2), n - 2), F.slice("words", F.lit(3), n - 2))
    two = one.select(
        "doc_id",
        *extra,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(zipped, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("seen"),
    )
    return two.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("seen")) < F.size("seen"), _covered(F.col("seen"))).otherwise(F.lit(0)).cast("long")).drop("seen")


def _covered(seen: Column) -> Column:
    """Words within windows whose hash occurs again: sort (hash, place) and compare neighbours."""
    ranked = F.array_sort(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(F.slice(ranked, F.lit(1), F.size(seen) - 1), F.slice(ranked, F.lit(2), F.size(seen) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def chi2_cdf(x: float, degrees: int) -> float:
    """Chi-square distribution of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < p else (low, mid)
    return high


def _quantile(rows: DataFrame, values: dict[str, Column], share: float, step: float) -> DataFrame:
    """For each ``grp`` the ``share`` quantile of each value, to the upper edge of its bin.

    Counts are dealt out by group once, for the running totals and for the quantiles.
    """
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.ceil(v / step).cast("long").alias("bin")) for k, v in values.items()])).alias("x")).select("grp", "x.k", "x.bin")
    counts = long.groupBy("grp", "k", "bin").agg(F.count("*").alias("n")).repartition("grp")
    own = W.partitionBy("grp", "k")
    below = counts.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    return below.where(F.col("upto") >= F.col("all") * share).groupBy("grp").agg(*[(F.min(F.when(F.col("k") == k, F.col("bin"))) * step).alias(k) for k in values])


def _distance(rows: DataFrame, fit: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Squared Mahalanobis distance of each row to its group's fit, by forward substitution, and the columns ``more`` of the fit."""
    out = rows.join(fit, "grp", "left")
    p = len(FEATURES)
    for i in range(p):
        z = F.col(FEATURES[i]) - F.col(f"c{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", z / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(p)])
    return out.select(*rows.columns, *more, d2.alias("d2"))


def _cholesky(moments: DataFrame, factor: float, more: Sequence[str] = ()) -> DataFrame:
    """Centre and lower factor of the inflated, floored covariance of each group, and the columns ``more`` of ``moments``."""
    p = len(FEATURES)
    out = moments.withColumns({f"c{i}": F.col(f"s{i}") / F.col("n") for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            cov = (F.col(f"s{j}{i}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}")) * factor
            rest = cov - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("grp", *[f"c{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], *more)


def robust_fit(rows: DataFrame, share: float, steps: int, still: float = 0.01) -> DataFrame:
    """``grp``, centre and Cholesky factor of each group's minimum-covariance-determinant estimate.

    Starts from medians and median deviations and takes concentration steps until no centre or factor
    of any group moves by more than ``still`` of its floor, ``steps`` at most.  A group's figures are one
    row, written before they are joined, so that Spark joins by their known size; how far they moved is
    observed as they are written.
    """
    p = len(FEATURES)
    factor = share / chi2_cdf(chi2_quantile(share, p), p + 2)
    centre = stored(_quantile(rows, {f"c{i}": F.col(f) for i, f in enumerate(FEATURES)}, 0.5, BIN), "centre")
    off = rows.join(centre, "grp")
    spread = _quantile(off, {f"m{i}": F.abs(F.col(f) - F.col(f"c{i}")) for i, f in enumerate(FEATURES)}, 0.5, BIN)
    figures = {f"c{i}": i for i in range(p)} | {f"l{i}{j}": i for i in range(p) for j in range(i + 1)}
    fit = stored(centre.join(spread, "grp").select("grp", *[f"c{i}" for i in range(p)], *[(F.sqrt(F.pow(F.col(f"m{i}") * 1.4826, F.lit(2)) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)]), "fit")
    log_d2 = F.log(F.col("d2") + 1e-9)
    first = [F.first(k).alias(f"was_{k}") for k in figures]
    sums = {f"s{i}": F.sum(f) for i, f in enumerate(FEATURES)} | {f"s{i}{j}": F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(p) for j in range(i, p)}
    for _ in range(steps):
        cut = _quantile(_distance(rows, fit).select("grp", log_d2.alias("log_d2")), {"cut": F.col("log_d2")}, share, BIN)
        fit = stored(fit.join(cut, "grp"), "cut")
        near = _distance(rows, fit, ["cut", *figures]).where(log_d2 <= F.col("cut"))
        after = near.groupBy("grp").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()], *first)
        seen = Observation()
        moved = F.max(F.greatest(*[F.abs(F.col(k) - F.col(f"was_{k}")) / FLOORS[i] for k, i in figures.items()]))
        fit = stored(_cholesky(after, factor, [f"was_{k}" for k in figures]).observe(seen, moved.alias("moved")).select("grp", *figures), "fit")
        if (most := seen.get.get("moved")) is None or most <= still:
            break
    return fit


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, steps: int = 25, tail: float = 1e-6, least: int = 40) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2`` of every row.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated three-word windows.
    Others are rejected if their squared distance passes the chi-square quantile at ``1 - tail``.
    Null text counts as empty and fails; null language or source is a group of its own; an empty
    table gives no rows; repeated ids are judged row by row.
    """
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = statistics(own).select(
        "*",
        failed.alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("word_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars") + F.col("n_symbols"), F.lit(1))).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("repeats"),
    )
    stats = stored(stats.withColumn("pair", F.xxhash64("lang", F.col("lang").isNull(), "source", F.col("source").isNull())), "statistics")
    sizes = stored(stats.where("not base_failed").groupBy("pair").agg(F.count("*").alias("fitted")).where(F.col("fitted") >= least), "sizes")
    rows = stats.join(sizes, "pair", "left").withColumn("grp", F.when(F.col("fitted").isNotNull(), F.col("pair")).otherwise(F.lit(0).cast("long"))).select("grp", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES)
    rows = stored(rows, "grouped")
    fit = robust_fit(rows.where("not base_failed").select("grp", *FEATURES), share, steps)
    judged = _distance(rows, fit)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - tail, len(FEATURES)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")
