"""Statistical queries over hits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.operators import sketches as K
from foldlattice.operators import statistics as S
from foldlattice.queries.hits import HITS, hits
from foldlattice.streaming.sweep import shared_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P = ", p AS (SELECT sk, ty, count(*) AS n, 1.0 / (1 + count(*) FILTER (WHERE source = 'P')) AS p FROM hits GROUP BY sk, ty)"


def _p_values(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "ty").agg(F.count("*").alias("n"), (F.lit(1.0) / (1 + F.count_if(F.col("source") == "P"))).alias("p"))


@query("bh_adjust", HITS + _P + ", r AS (SELECT *, row_number() OVER (ORDER BY p, sk, ty) AS k, count(*) OVER () AS m FROM p) SELECT sk, ty, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def bh_adjust(spark, sf_dir):
    return S.bh_adjust(_p_values(spark, sf_dir)).select("sk", "ty", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("poisson_binomial_cdf", """WITH RECURSIVE t AS (SELECT l_orderkey AS record, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m, (l_partkey % 97 + 1) / 101.0 AS p FROM lineitem),
d AS (SELECT record, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS x, CAST(1 AS DOUBLE) AS pr FROM (SELECT DISTINCT record FROM t) UNION ALL
  SELECT record, k, x, sum(pr) FROM (SELECT d.record, t.k, d.x + b.hit AS x, d.pr * CASE WHEN b.hit = 1 THEN t.p ELSE 1 - t.p END AS pr FROM d JOIN t ON t.record = d.record AND t.k = d.k + 1, (SELECT unnest([0, 1]) AS hit) b) GROUP BY record, k, x)
SELECT d.record, round(sum(pr), 6) AS at_most_2 FROM d JOIN (SELECT record, max(m) AS m FROM t GROUP BY 1) w ON w.record = d.record AND w.m = d.k WHERE x <= 2 GROUP BY d.record""")
def poisson_binomial_cdf(spark, sf_dir):
    """Chance of at most two hits among an order's lines, each with its own share."""
    from foldlattice.fixtures import read

    shares = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), ((F.col("l_partkey") % 97 + 1) / 101.0).alias("p"))
    return S.poisson_binomial(shares, ["record"], "p", 2).select("record", F.round(S.at_most(F.col("chances")), 6).alias("at_most_2"))


@query("supplier_poisson_binomial", """WITH RECURSIVE t AS (SELECT l_suppkey AS supplier, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k, (l_partkey % 97 + 1) / 9973.0 AS p FROM lineitem),
d AS (SELECT supplier, CAST(0 AS BIGINT) AS k, [CAST(1 AS DOUBLE), 0, 0, 0] AS c FROM (SELECT DISTINCT supplier FROM t) UNION ALL
  SELECT d.supplier, t.k, [c[1] * (1 - p), c[2] * (1 - p) + c[1] * p, c[3] * (1 - p) + c[2] * p, c[4] * (1 - p) + c[3] * p] FROM d JOIN t ON t.supplier = d.supplier AND t.k = d.k + 1)
SELECT d.supplier, round(c[1] + c[2] + c[3] + c[4], 6) AS at_most_3 FROM d JOIN (SELECT supplier, max(k) AS k FROM t GROUP BY 1) w USING (supplier, k)""")
def supplier_poisson_binomial(spark, sf_dir):
    """Chance of at most three hits among all lines of a supplier: groups that grow with the table."""
    from foldlattice.fixtures import read

    shares = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), ((F.col("l_partkey") % 97 + 1) / 9973.0).alias("p"))
    return S.poisson_binomial(shares, ["supplier"], "p", 3).select("supplier", F.round(S.at_most(F.col("chances")), 6).alias("at_most_3"))


@query("thinned_expectation", HITS + _P + " SELECT sk, round(exp(sum(ln(1 - p * 0.5))), 6) AS none, round(sum(p * 0.5), 6) AS expected FROM p GROUP BY sk")
def thinned_expectation(spark, sf_dir):
    thin = _p_values(spark, sf_dir).withColumn("s", F.col("p") * 0.5)
    return thin.groupBy("sk").agg(F.round(S.no_hit_probability("s"), 6).alias("none"), F.round(F.sum("s"), 6).alias("expected"))


@query("mann_whitney", HITS + """, v AS (SELECT hgroup, CAST(floor(value / 1000) AS BIGINT) AS v, source = 'P' AS a FROM hits), c AS (SELECT hgroup, v, count(*) FILTER (WHERE a) AS a, count(*) AS n FROM v GROUP BY hgroup, v),
r AS (SELECT *, sum(n) OVER (PARTITION BY hgroup ORDER BY v) - (n - 1) / 2.0 AS rank FROM c), s AS (SELECT hgroup, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(n - a) AS DOUBLE) AS n2, CAST(sum(a * rank) AS DOUBLE) AS r1, CAST(sum(n * n * n - n) AS DOUBLE) AS ties FROM r GROUP BY hgroup)
SELECT hgroup, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(r1 - n1 * (n1 + 1) / 2, 3) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 5) AS z FROM s""")
def mann_whitney(spark, sf_dir):
    own = hits(spark, sf_dir).withColumn("v0", F.floor(F.col("value") / 1000).cast("long"))
    return S.mann_whitney(own, "v0", F.col("source") == "P", ["hgroup"]).select("hgroup", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 5).alias("z"))


@query("sign_test", HITS + ", d AS (SELECT fold, sum(CASE WHEN source = 'P' THEN value ELSE -value END) AS d FROM hits GROUP BY fold) SELECT count(*) FILTER (WHERE d > 0) AS plus, count(*) FILTER (WHERE d < 0) AS minus, round((count(*) FILTER (WHERE d > 0) - count(*) FILTER (WHERE d < 0)) / sqrt(count(*) FILTER (WHERE d <> 0)), 6) AS z FROM d")
def sign_test(spark, sf_dir):
    d = hits(spark, sf_dir).groupBy("fold").agg(F.sum(F.when(F.col("source") == "P", F.col("value")).otherwise(-F.col("value"))).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus")).withColumn("z", F.round(S.sign_test_z(F.col("plus"), F.col("minus")), 6))


@query("two_proportion_z", HITS + """, c AS (SELECT sk, CAST(count(*) FILTER (WHERE source = 'P' AND value > 200000) AS DOUBLE) AS x1, CAST(count(*) FILTER (WHERE source = 'P') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE source <> 'P' AND value > 200000) AS DOUBLE) AS x2, CAST(count(*) FILTER (WHERE source <> 'P') AS DOUBLE) AS n2 FROM hits GROUP BY sk)
SELECT sk, round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM c""")
def two_proportion_z(spark, sf_dir):
    p, big = F.col("source") == "P", F.col("value") > 200000
    c = hits(spark, sf_dir).groupBy("sk").agg(F.count_if(p & big).alias("x1"), F.count_if(p).alias("n1"), F.count_if(~p & big).alias("x2"), F.count_if(~p).alias("n2"))
    return c.select("sk", F.round(S.two_proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")), 6).alias("z"))


@query("within_group_slope", HITS + ", c AS (SELECT fold, year - avg(year) OVER (PARTITION BY fold) AS x, value - avg(value) OVER (PARTITION BY fold) AS y FROM hits) SELECT round(regr_slope(y, x), 3) AS slope, count(*) AS n FROM c")
def within_group_slope(spark, sf_dir):
    own = hits(spark, sf_dir)
    means = own.groupBy("fold").agg(F.avg("year").alias("mx"), F.avg("value").alias("my"))
    c = own.join(means, "fold").select((F.col("year") - F.col("mx")).alias("x"), (F.col("value") - F.col("my")).alias("y"))
    return c.agg(F.round(F.regr_slope("y", "x"), 3).alias("slope"), F.count("*").alias("n"))


@query("threshold_agreement", HITS + ", c AS (SELECT domain, avg(value) AS a, max(value) AS b FROM hits GROUP BY domain) SELECT round(corr(a, b), 5) AS r, round(avg(abs(a - b)), 3) AS mean_gap, round(avg(CASE WHEN (a > 200000) = (b > 200000) THEN 1.0 ELSE 0.0 END), 6) AS same_side FROM c")
def threshold_agreement(spark, sf_dir):
    c = hits(spark, sf_dir).groupBy("domain").agg(F.avg("value").alias("a"), F.max("value").alias("b"))
    same = (F.col("a") > 200000) == (F.col("b") > 200000)
    return c.agg(F.round(F.corr("a", "b"), 5).alias("r"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 3).alias("mean_gap"), F.round(F.avg(same.cast("double")), 6).alias("same_side"))


_HASH = "((({k}) + {s}) * 2654435761 % 1000003) / 1000003.0"


@query("rarefaction_hash", HITS + f", q AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS q), r AS (SELECT unnest([1, 2, 3]) AS rep), n AS (SELECT q, rep, count(DISTINCT (sk, ty, fold)) AS n FROM hits, q, r WHERE {_HASH.format(k='record', s='rep * 7919')} < q GROUP BY q, rep) SELECT CAST(q AS DOUBLE) AS q, round(avg(n), 4) AS mean_lit FROM n GROUP BY q")
def rarefaction_hash(spark, sf_dir):
    """Lit (cell, fold) pairs at nested sample shares, averaged over repeats; samples are hash thresholds."""
    own = hits(spark, sf_dir).select("record", "sk", "ty", "fold", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("rep"))
    own = own.withColumn("h", S.hash_share(F.col("record") + F.col("rep") * 7919)).withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 1.0)]))).where("h < q")
    return own.groupBy("q", "rep").agg(F.countDistinct("sk", "ty", "fold").alias("n")).groupBy("q").agg(F.round(F.avg("n"), 4).alias("mean_lit"))


@query("jaccard_null_hash", HITS + f", h AS (SELECT sk, ty, fold, {_HASH.format(k='record', s='0')} AS h FROM hits), c AS (SELECT sk, ty, fold, bool_or(h < 0.3) AS a, bool_or(h >= 0.3 AND h < 0.6) AS b FROM h GROUP BY sk, ty, fold) SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a OR b) AS either, round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b), 6) AS jaccard FROM c")
def jaccard_null_hash(spark, sf_dir):
    h = S.hash_share(F.col("record"))
    c = hits(spark, sf_dir).groupBy("sk", "ty", "fold").agg(F.bool_or(h < 0.3).alias("a"), F.bool_or((h >= 0.3) & (h < 0.6)).alias("b"))
    both, either = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return c.agg(both.alias("both"), either.alias("either"), F.round(both / either, 6).alias("jaccard"))


_REPEATS = 20


@query("size_matched_jaccard", HITS + f""", b AS (SELECT DISTINCT sk, ty, fold FROM hits WHERE source = 'P'), k AS (SELECT count(*) AS k FROM hits WHERE source = 'P'),
r AS (SELECT rep, sk, ty, fold, row_number() OVER (PARTITION BY rep ORDER BY (record + rep * 7919) * 2654435761 % 1000003, record) AS place FROM hits, range(1, {_REPEATS + 1}) t(rep) WHERE source = 'F'),
s AS (SELECT DISTINCT rep, sk, ty, fold FROM r, k WHERE place <= k.k),
j AS (SELECT rep, count(b.sk) AS shared, count(*) + (SELECT count(*) FROM b) - count(b.sk) AS either FROM s LEFT JOIN b USING (sk, ty, fold) GROUP BY rep)
SELECT (SELECT k FROM k) AS size, count(*) AS repeats, round(avg(shared / either), 6) AS mean, round(stddev_samp(shared / either), 6) AS deviation FROM j""")
def size_matched_jaccard(spark, sf_dir):
    """Overlap of lit cells between a small source and samples of a large one of exactly its size."""
    own = hits(spark, sf_dir)
    small = own.where("source = 'P'")
    size = small.count()
    large = own.where("source = 'F'").select("record", "sk", "ty", "fold", F.explode(F.sequence(F.lit(1), F.lit(_REPEATS))).alias("rep"))
    sample = S.exact_samples(large, (F.col("record") + F.col("rep") * 7919) * 2654435761 % 1000003, 1000003, F.col("record"), [size], ["rep"])
    lit = small.select("sk", "ty", "fold").distinct().withColumn("b", F.lit(1))
    met = sample.select("rep", "sk", "ty", "fold").distinct().join(lit, ["sk", "ty", "fold"], "left").groupBy("rep").agg(F.count("b").alias("both"), F.count("*").alias("n"))
    share = F.col("both") / (F.col("n") + F.col("small") - F.col("both"))
    per = met.join(F.broadcast(lit.agg(F.count("*").alias("small")))).select("rep", share.alias("j"))
    return per.agg(F.lit(size).cast("long").alias("size"), F.count("*").alias("repeats"), F.round(F.avg("j"), 6).alias("mean"), F.round(F.stddev_samp("j"), 6).alias("deviation"))


_SIZES = (1000, 3000, 9000)


@query("nested_sample_curve", HITS + f""", r AS (SELECT rep, sk, ty, fold, row_number() OVER (PARTITION BY rep ORDER BY (record + rep * 7919) * 2654435761 % 1000003, record) AS place FROM hits, range(1, 6) t(rep)),
n AS (SELECT size, rep, count(DISTINCT (sk, ty, fold)) AS n FROM r, (SELECT unnest([{', '.join(map(str, _SIZES))}]) AS size) WHERE place <= size GROUP BY size, rep)
SELECT CAST(size AS INTEGER) AS size, round(avg(n), 4) AS mean_lit, round(stddev_samp(n), 4) AS deviation FROM n GROUP BY size""")
def nested_sample_curve(spark, sf_dir):
    """Lit (cell, fold) pairs of nested samples of exact sizes, their mean and deviation over repeats."""
    own = hits(spark, sf_dir).select("record", "sk", "ty", "fold", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rep"))
    sample = S.exact_samples(own, (F.col("record") + F.col("rep") * 7919) * 2654435761 % 1000003, 1000003, F.col("record"), list(_SIZES), ["rep"])
    per = sample.groupBy("size", "rep").agg(F.countDistinct("sk", "ty", "fold").alias("n"))
    return per.groupBy("size").agg(F.round(F.avg("n"), 4).alias("mean_lit"), F.round(F.stddev_samp("n"), 4).alias("deviation"))


@query("sketched_cells", HITS + """, c AS (SELECT sk, domain, bool_or(source = 'F') AS a, bool_or(source = 'O') AS b FROM hits GROUP BY sk, domain)
SELECT sk, count(*) AS n_domains, count(*) FILTER (WHERE a AND b) AS n_both, true AS domains_ok, true AS both_ok FROM c GROUP BY sk""")
def sketched_cells(spark, sf_dir):
    """Domains of each cell, and those that two sources share, estimated from stored sketches of parts and held against exact counts."""
    own = hits(spark, sf_dir)
    path = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    K.store_sketches(own.withColumn("part", F.pmod("record", F.lit(4))), ["sk", "source"], "part", "domain", path)
    whole = K.merged(spark, path, ["sk"]).select("sk", F.theta_sketch_estimate("sketch").alias("domains"))
    two = K.shared(spark, path, ["sk"], "source", "F", "O").select("sk", "both", "either")
    seen = own.groupBy("sk", "domain").agg(F.bool_or(F.col("source") == "F").alias("a"), F.bool_or(F.col("source") == "O").alias("b"))
    exact = seen.groupBy("sk").agg(F.count("*").alias("n_domains"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_either"))
    near = lambda estimate, n, of: F.abs(F.col(estimate) - F.col(n)) <= K.BOUND * F.col(of)
    return exact.join(whole, "sk").join(two, "sk").select("sk", "n_domains", "n_both", near("domains", "n_domains", "n_domains").alias("domains_ok"), near("both", "n_both", "n_either").alias("both_ok"))


_CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"
_FISHER = HITS + f""", w AS (SELECT count(*) FILTER (WHERE source = 'P') AS wp, count(*) FILTER (WHERE source <> 'P') AS wo FROM hits), c AS (SELECT sk, ty, count(*) FILTER (WHERE source = 'P') AS a, count(*) FILTER (WHERE source <> 'P') AS b FROM hits GROUP BY 1, 2),
t AS (SELECT c.*, wp, wp + wo AS n, unnest(range(greatest(0, a + b - wo), least(a + b, wp) + 1)) AS k FROM c, w),
l AS (SELECT sk, ty, a, b, {_CHOOSE.format(n='wp', k='k')} + {_CHOOSE.format(n='(n - wp)', k='(a + b - k)')} - ({_CHOOSE.format(n='n', k='(a + b)')}) AS lp, k = a AS seen FROM t),
s AS (SELECT sk, ty, max(CASE WHEN seen THEN lp END) AS lp FROM l GROUP BY 1, 2),
p AS (SELECT l.sk, l.ty, a, b, least(1.0, sum(CASE WHEN l.lp <= s.lp + 1e-7 THEN exp(l.lp) ELSE 0 END)) AS p FROM l JOIN s USING (sk, ty) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (ORDER BY p, sk, ty) AS k, count(*) OVER () AS m FROM p)
SELECT sk, ty, a, b, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r"""


@query("fisher_exact", _FISHER)
def fisher_exact(spark, sf_dir):
    own = hits(spark, sf_dir)
    whole = own.agg(F.count_if(F.col("source") == "P").alias("wp"), F.count_if(F.col("source") != "P").alias("wo"))
    cells = own.groupBy("sk", "ty").agg(F.count_if(F.col("source") == "P").alias("a"), F.count_if(F.col("source") != "P").alias("b")).crossJoin(whole)
    tested = S.fisher_exact(cells.withColumns({"c": F.col("wp") - F.col("a"), "d": F.col("wo") - F.col("b")}), "a", "b", "c", "d")
    return S.bh_adjust(tested.select("sk", "ty", "a", "b", "p")).select("sk", "ty", "a", "b", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_BINOM = HITS + f""", c AS (SELECT sk, count(*) FILTER (WHERE source = 'P') AS k, count(*) AS n FROM hits GROUP BY 1), t AS (SELECT *, unnest(range(0, n + 1)) AS i FROM c), l AS (SELECT sk, k, n, i, {_CHOOSE.format(n='n', k='i')} + n * ln(0.5) AS lp FROM t), s AS (SELECT sk, lp FROM l WHERE i = k)
SELECT l.sk, k, n, 0.5::DOUBLE AS share, round(least(1.0, sum(CASE WHEN l.lp <= s.lp + 1e-7 THEN exp(l.lp) ELSE 0 END)), 6) AS p_binom, round(least(1.0, sum(CASE WHEN i >= k THEN exp(l.lp) ELSE 0 END)), 6) AS p_greater FROM l JOIN s USING (sk) GROUP BY 1, 2, 3"""


@query("binom_test", _BINOM)
def binom_test(spark, sf_dir):
    cells = hits(spark, sf_dir).groupBy("sk").agg(F.count_if(F.col("source") == "P").alias("k"), F.count("*").alias("n")).withColumn("share", F.lit(0.5))
    both = S.binomial_test(S.binomial_test(cells, "k", "n", "share"), "k", "n", "share", "p_greater", greater=True)
    return both.withColumns({c: F.round(c, 6) for c in ("p_binom", "p_greater")})
