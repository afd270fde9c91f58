"""Attribute joins, names, ranks and reports over hits; the same stand-ins as in ``hits``."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.fixtures import read
from foldlattice.functions import geometry as G
from foldlattice.functions import names as N
from foldlattice.operators.overlap import majority_domains
from foldlattice.operators.statistics import normal_cdf
from foldlattice.queries.hits import HITS, hits
from foldlattice.queries.motifs import GEOM, _pairs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NAMED = "concat(CASE p_size % 3 WHEN 0 THEN 'dpam_' ELSE '' END, 'A', p_partkey, CASE p_size % 4 WHEN 0 THEN '_nD' WHEN 1 THEN '_D' ELSE '' END, CASE WHEN p_size % 4 < 2 THEN cast(p_size as {text}) ELSE '' END)"


@query("name_parts", f"""WITH n AS (SELECT p_partkey, p_partkey % 198 AS sk, p_size % 32 AS ty, {_NAMED.format(text='VARCHAR')} AS record, p_size || '.' || p_partkey % 7 || '.' || p_partkey % 5 AS t_group, lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '/07/' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS day, p_size FROM part)
SELECT p_partkey, 's5-' || lpad(CAST(sk AS VARCHAR), 4, '0') || '-' || lpad(CAST(ty AS VARCHAR), 4, '0') AS cell, CAST(sk AS INTEGER) AS sk, CAST(ty AS INTEGER) AS ty, p_partkey % 7 AS second, split_part(t_group, '.', 1) || '.' || split_part(t_group, '.', 2) AS h_group,
'A' || p_partkey AS accession, CAST(CASE WHEN p_size % 4 < 2 THEN p_size ELSE 0 END AS INTEGER) AS domain, CAST(CASE WHEN p_partkey % 100 > 30 THEN 1900 ELSE 2000 END + p_partkey % 100 AS INTEGER) AS year FROM n""")
def name_parts(spark, sf_dir):
    """Cells, groups, accessions, domain numbers and years written as names and read back."""
    day = "concat(lpad(cast(p_size % 12 + 1 as string), 2, '0'), '/07/', lpad(cast(p_partkey % 100 as string), 2, '0'))"
    own = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{N.cell_name('p_partkey % 198', 'p_size % 32')} AS cell", "concat_ws('.', p_size, p_partkey % 7, p_partkey % 5) AS t_group", f"{_NAMED.format(text='string')} AS record", f"{day} AS day")
    return own.selectExpr("p_partkey", "cell", f"{N.cell_part('cell', 1)} AS sk", f"{N.cell_part('cell', 2)} AS ty", "cast(split(t_group, '[.]')[1] as bigint) AS second", f"{N.h_group('t_group')} AS h_group", f"{N.accession('record')} AS accession", f"coalesce({N.domain_number('record')}, 0) AS domain", f"{N.year_of('day')} AS year")


@query("range_parse", "SELECT p_partkey, n + 1 AS part, CASE WHEN n = 0 THEN 'A' ELSE '' END AS chain, p_partkey + 100 * n AS lo, p_partkey + 100 * n + p_size AS hi FROM part, range(2) r(n)")
def range_parse(spark, sf_dir):
    text = "concat('A:', p_partkey, '-', p_partkey + p_size, ', ', p_partkey + 100, '-', p_partkey + 100 + p_size, ',none')"
    own = read(spark, sf_dir, "part").selectExpr("p_partkey", f"{N.ranges_of(text)} AS r")
    return own.select("p_partkey", F.posexplode("r").alias("n", "x")).select("p_partkey", (F.col("n") + 1).cast("long").alias("part"), "x.chain", "x.lo", "x.hi")


@query("pair_line_angle", GEOM + f"SELECT a.record_id, a.pos AS i, b.pos AS j, round({N.line_angle(G.angle('a', 'b'))}, 5) AS angle FROM el1 a JOIN el1 b ON a.record_id = b.record_id AND a.pos < b.pos")
def pair_line_angle(spark, sf_dir):
    return _pairs(spark, sf_dir).select("record_id", "i", "j", F.expr(f"round({N.line_angle(G.angle('a', 'b'))}, 5)").alias("angle"))


@query("majority_overlap", """WITH seg AS (SELECT l_orderkey AS record_id, l_suppkey % 2 AS motif, CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'B' END AS chain, l_linenumber * 20 AS lo, l_linenumber * 20 + CAST(l_quantity AS BIGINT) % 19 AS hi FROM lineitem),
dom AS (SELECT o_orderkey AS record_id, d AS domain, CASE WHEN d = 0 AND o_custkey % 5 = 0 THEN NULL WHEN d % 2 = 0 THEN 'a' ELSE 'B' END AS chain, CASE WHEN d = 3 THEN NULL ELSE d * 30 END AS lo, CASE WHEN d = 3 THEN NULL ELSE d * 30 + 45 END AS hi FROM orders, range(4) r(d)),
w AS (SELECT record_id, motif, sum(hi - lo + 1) AS whole FROM seg GROUP BY 1, 2),
s AS (SELECT seg.record_id, seg.motif, domain, sum(CASE WHEN dom.lo IS NULL THEN seg.hi - seg.lo + 1 ELSE greatest(0, least(seg.hi, dom.hi) - greatest(seg.lo, dom.lo) + 1) END) AS shared FROM seg JOIN dom ON seg.record_id = dom.record_id AND (dom.chain IS NULL OR lower(dom.chain) = lower(seg.chain)) GROUP BY 1, 2, 3)
SELECT record_id, CAST(motif AS BIGINT) AS motif, domain, CAST(shared AS BIGINT) AS shared, CAST(whole AS BIGINT) AS whole FROM (SELECT s.*, w.whole, row_number() OVER (PARTITION BY s.record_id, s.motif ORDER BY domain) AS r FROM s JOIN w USING (record_id, motif) WHERE 2 * shared > whole) WHERE r = 1""")
def majority_overlap(spark, sf_dir):
    seg = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS record_id", "l_suppkey % 2 AS motif", "CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'B' END AS chain", "cast(l_linenumber * 20 as bigint) AS lo", "l_linenumber * 20 + cast(l_quantity as bigint) % 19 AS hi")
    dom = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("d"))
    dom = dom.selectExpr("o_orderkey AS record_id", "d AS domain", "d AS place", "CASE WHEN d = 0 AND o_custkey % 5 = 0 THEN NULL WHEN d % 2 = 0 THEN 'a' ELSE 'B' END AS chain", "CASE WHEN d <> 3 THEN d * 30 END AS lo", "CASE WHEN d <> 3 THEN d * 30 + 45 END AS hi")
    return majority_domains(seg, dom)


@query("node_descriptions", """SELECT c_custkey, n_nationkey AS fold, n_name AS fold_name, r_name AS class_name FROM (SELECT c_custkey, 'cl=' || n_regionkey || ',cf=' || c_nationkey || ',sf=' || c_custkey % 9 AS node FROM customer JOIN nation ON c_nationkey = n_nationkey) x
JOIN nation ON n_nationkey = CAST(regexp_extract(node, 'cf=([0-9]+)', 1) AS INTEGER) JOIN region ON r_regionkey = CAST(regexp_extract(node, 'cl=([0-9]+)', 1) AS INTEGER)""")
def node_descriptions(spark, sf_dir):
    """Comma lists of node keys to the descriptions of two of their levels."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    nodes = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "concat('cl=', n_regionkey, ',cf=', c_nationkey, ',sf=', c_custkey % 9) AS node")
    keys = nodes.selectExpr("c_custkey", "cast(regexp_extract(node, 'cf=([0-9]+)', 1) as int) AS cf", "cast(regexp_extract(node, 'cl=([0-9]+)', 1) as int) AS cl")
    return keys.join(nation, F.col("cf") == F.col("n_nationkey")).join(region, F.col("cl") == F.col("r_regionkey")).select("c_custkey", F.col("n_nationkey").alias("fold"), F.col("n_name").alias("fold_name"), F.col("r_name").alias("class_name"))


@query("pushed_ids", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pushed_ids(spark, sf_dir):
    """Attributes of a list of ids only."""
    ids = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("cluster_counts", HITS + ", m AS (SELECT c_custkey AS member, c_custkey - c_custkey % 7 AS rep FROM customer WHERE c_custkey % 11 <> 0) SELECT sk, ty, count(DISTINCT coalesce(rep, domain)) AS clusters, count(DISTINCT domain) AS domains FROM hits LEFT JOIN m ON domain = member GROUP BY sk, ty")
def cluster_counts(spark, sf_dir):
    """Clusters per cell by a given member map; who is in none stands for itself."""
    members = read(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").selectExpr("c_custkey AS domain", "c_custkey - c_custkey % 7 AS rep")
    return hits(spark, sf_dir).join(members, "domain", "left").groupBy("sk", "ty").agg(F.countDistinct(F.coalesce("rep", "domain")).alias("clusters"), F.countDistinct("domain").alias("domains"))


@query("attribute_strata", HITS + """, p AS (SELECT o_orderkey AS record, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS plddt FROM orders)
SELECT method, CASE WHEN plddt IS NULL THEN 'unknown' WHEN plddt >= 70 THEN 'high' ELSE 'low' END AS stratum, count(*) AS n_hits, count(DISTINCT fold) AS folds, round(avg(plddt), 6) AS mean_plddt FROM hits LEFT JOIN p USING (record) GROUP BY 1, 2""")
def attribute_strata(spark, sf_dir):
    """Hits by method and by a confidence that some records lack."""
    plddt = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS record", "CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_orderkey % 101 as double) END AS plddt")
    stratum = F.when(F.col("plddt").isNull(), "unknown").when(F.col("plddt") >= 70, "high").otherwise("low").alias("stratum")
    return hits(spark, sf_dir).join(plddt, "record", "left").groupBy("method", stratum).agg(F.count("*").alias("n_hits"), F.countDistinct("fold").alias("folds"), F.round(F.avg("plddt"), 6).alias("mean_plddt"))


_CELL_RATIO = ", c AS (SELECT sk, ty, count(DISTINCT CASE WHEN source = 'P' THEN fold END) AS a, count(DISTINCT domain) AS b FROM hits GROUP BY sk, ty)"


def _cell_ratio(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "ty").agg(F.countDistinct(F.when(F.col("source") == "P", F.col("fold"))).alias("a"), F.countDistinct("domain").alias("b"))


@query("ratio_percentiles", HITS + _CELL_RATIO + """ SELECT count(*) AS cells, round(avg(b / a), 6) AS mean, round(median(b / a), 6) AS median, round(quantile_cont(b / a, 0.1), 6) AS p10, round(quantile_cont(b / a, 0.25), 6) AS p25, round(quantile_cont(b / a, 0.75), 6) AS p75, round(quantile_cont(b / a, 0.9), 6) AS p90,
round(sum(b) / sum(a), 6) AS ratio_of_totals, round(avg(CASE WHEN b >= a THEN 1.0 ELSE 0.0 END), 6) AS at_least FROM c WHERE a > 0""")
def ratio_percentiles(spark, sf_dir):
    """Multipliers of cells: mean, percentiles, ratio of totals."""
    c = _cell_ratio(spark, sf_dir).where("a > 0").withColumn("m", F.col("b") / F.col("a"))
    of = [F.round(F.percentile("m", q), 6).alias(k) for k, q in (("median", 0.5), ("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))]
    return c.agg(F.count("*").alias("cells"), F.round(F.avg("m"), 6).alias("mean"), *of, F.round(F.sum("b") / F.sum("a"), 6).alias("ratio_of_totals"), F.round(F.avg((F.col("b") >= F.col("a")).cast("double")), 6).alias("at_least"))


@query("top_cells", HITS + _CELL_RATIO + " SELECT sk, ty, a, b, round(b / a, 6) AS ratio FROM c WHERE a > 0 ORDER BY b / a DESC, sk, ty LIMIT 15")
def top_cells(spark, sf_dir):
    """The fifteen cells of largest multiplier; a report of the largest is what it is for."""
    return _cell_ratio(spark, sf_dir).where("a > 0").withColumn("m", F.col("b") / F.col("a")).orderBy(F.desc("m"), "sk", "ty").limit(15).select("sk", "ty", "a", "b", F.round("m", 6).alias("ratio"))


@query("grid_row_order", HITS + " SELECT sk, count(*) AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, sk) AS INTEGER) AS place FROM hits GROUP BY sk")
def grid_row_order(spark, sf_dir):
    """Skeletons by falling total, then by number; one row a skeleton is ranked."""
    return hits(spark, sf_dir).groupBy("sk").agg(F.count("*").alias("total")).withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), "sk")))


_RC = "CASE WHEN l_discount > 0.09 THEN 137 WHEN l_tax > 0.07 THEN 1 ELSE 0 END"


@query("exit_codes", f"SELECT CAST({_RC} AS INTEGER) AS rc, count(*) AS parts, count(*) FILTER (WHERE l_quantity > 45) AS slow, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def exit_codes(spark, sf_dir):
    """Task parts by exit code."""
    per = read(spark, sf_dir, "lineitem").groupBy(F.expr(f"cast({_RC} as int)").alias("rc")).agg(F.count("*").alias("parts"), F.count_if(F.col("l_quantity") > 45).alias("slow"))
    return per.withColumn("share", F.round(F.col("parts") / F.sum("parts").over(W.partitionBy(F.lit(1))), 6))  # one row a code


_DEPTH = """, q AS (SELECT count(DISTINCT domain) FILTER (WHERE source = 'P') / count(DISTINCT domain) AS q FROM hits), k AS (SELECT sk, fold, count(*) AS k FROM hits GROUP BY 1, 2), o AS (SELECT sk, count(DISTINCT fold) FILTER (WHERE source = 'P') AS seen FROM hits GROUP BY 1),
s AS (SELECT sk, 1 - pow(1 - q * 0.05, k) AS s FROM k, q), m AS (SELECT sk, sum(s) AS mu, sqrt(sum(s * (1 - s))) AS sd, exp(sum(ln(1 - s))) AS none FROM s GROUP BY sk)"""


@query("depth_ratio", HITS + " SELECT count(DISTINCT domain) FILTER (WHERE source = 'P') AS a, count(DISTINCT domain) AS b, round(count(DISTINCT domain) FILTER (WHERE source = 'P') / count(DISTINCT domain), 9) AS q FROM hits")
def depth_ratio(spark, sf_dir):
    """How many of all domains one source has; a ratio outside of (0, 1) is an error."""
    own = hits(spark, sf_dir).agg(F.countDistinct(F.when(F.col("source") == "P", F.col("domain"))).alias("a"), F.countDistinct("domain").alias("b"))
    q = F.try_divide(F.col("a"), F.col("b"))
    return own.withColumn("q", F.when((q > 0) & (q < 1), F.round(q, 9)).otherwise(F.raise_error(F.lit("the depth ratio must lie between 0 and 1")).cast("double")))


def _erf_sql(x: str) -> str:
    """Error function by its power series, as ``statistics.normal_cdf`` has it."""
    terms = " + ".join(f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r} * pow({x}, {2 * n + 1})" for n in range(60))
    return f"CASE WHEN {x} > 4 THEN 1 WHEN {x} < -4 THEN -1 ELSE {2 / math.sqrt(math.pi)!r} * ({terms}) END"


@query("depth_corrected", HITS + _DEPTH + f""" SELECT m.sk, seen, round(mu, 5) AS mu, round(sd, 5) AS sd, round(CASE WHEN seen = 0 THEN 2 * least(none, 0.5) ELSE 2 * least(0.5 * (1 + {_erf_sql('((seen + 0.5 - mu) / (sd * sqrt(2)))')}), 1 - 0.5 * (1 + {_erf_sql('((seen - 0.5 - mu) / (sd * sqrt(2)))')}), 0.5) END, 4) AS p FROM m JOIN o USING (sk)""")
def depth_corrected(spark, sf_dir):
    """Two-sided chance of the folds seen by one source if the other's were thinned to its depth: normal approximation with continuity correction."""
    own = hits(spark, sf_dir)
    q = own.agg(F.try_divide(F.countDistinct(F.when(F.col("source") == "P", F.col("domain"))), F.countDistinct("domain")).alias("q"))
    left = own.groupBy("sk", "fold").agg(F.count("*").alias("k")).crossJoin(q).withColumn("s", 1 - F.pow(1 - F.col("q") * 0.05, F.col("k")))
    m = left.groupBy("sk").agg(F.sum("s").alias("mu"), F.sqrt(F.sum(F.col("s") * (1 - F.col("s")))).alias("sd"), F.exp(F.sum(F.col("k") * F.log(1 - F.col("q") * 0.05))).alias("none"))  # 1 - s itself may be 0
    seen = own.groupBy("sk").agg(F.countDistinct(F.when(F.col("source") == "P", F.col("fold"))).alias("seen"))
    # without spread, what is seen lies wholly on one side
    upper, lower = (normal_cdf(F.coalesce(F.try_divide(x, F.col("sd")), F.signum(x) * 1e9)) for x in (F.col("seen") + half - F.col("mu") for half in (0.5, -0.5)))
    p = F.when(F.col("seen") == 0, 2 * F.least("none", F.lit(0.5))).otherwise(2 * F.least(upper, 1 - lower, F.lit(0.5)))
    return m.join(seen, "sk").select("sk", "seen", F.round("mu", 5).alias("mu"), F.round("sd", 5).alias("sd"), F.round(p, 4).alias("p"))


@query("quadrants_incomplete", HITS + """, a AS (SELECT sk, ty, count(*) FILTER (WHERE value > 200000) AS n FROM hits WHERE source = 'P' GROUP BY 1, 2), b AS (SELECT sk, ty, count(*) FILTER (WHERE value > 400000) AS n FROM hits WHERE source = 'F' GROUP BY 1, 2)
SELECT coalesce(a.sk, b.sk) AS sk, coalesce(a.ty, b.ty) AS ty, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'incomplete' WHEN a.n = 0 AND b.n = 0 THEN 'truly_absent' WHEN a.n = 0 THEN 'only_b' WHEN b.n = 0 THEN 'loss' ELSE 'common' END AS quadrant FROM a FULL JOIN b ON a.sk = b.sk AND a.ty = b.ty""")
def quadrants_incomplete(spark, sf_dir):
    """Quadrants of two sources' strong hits where a source may lack a cell."""
    own = hits(spark, sf_dir)
    a = own.where("source = 'P'").groupBy("sk", "ty").agg(F.count_if(F.col("value") > 200000).alias("a"))
    b = own.where("source = 'F'").groupBy("sk", "ty").agg(F.count_if(F.col("value") > 400000).alias("b"))
    label = "CASE WHEN a IS NULL OR b IS NULL THEN 'incomplete' WHEN a = 0 AND b = 0 THEN 'truly_absent' WHEN a = 0 THEN 'only_b' WHEN b = 0 THEN 'loss' ELSE 'common' END"
    return a.join(b, ["sk", "ty"], "full").select("sk", "ty", F.expr(label).alias("quadrant"))


@query("sharing_per_cell", HITS + ", c AS (SELECT source, sk, ty, count(DISTINCT fold) AS n FROM hits GROUP BY 1, 2, 3) SELECT source, count(*) AS lit, round(avg(n), 6) AS mean_folds, round(median(n), 6) AS median_folds FROM c GROUP BY source")
def sharing_per_cell(spark, sf_dir):
    """Folds that share a lit cell, by source."""
    c = hits(spark, sf_dir).groupBy("source", "sk", "ty").agg(F.countDistinct("fold").alias("n"))
    return c.groupBy("source").agg(F.count("*").alias("lit"), F.round(F.avg("n"), 6).alias("mean_folds"), F.round(F.percentile("n", 0.5), 6).alias("median_folds"))


@query("group_members", HITS + ", g AS (SELECT sk, fold, list_sort(list(DISTINCT domain)) AS d FROM hits GROUP BY 1, 2) SELECT sk, fold, CAST(len(d) AS INTEGER) AS n, array_to_string(d[1:3], ',') AS members FROM g")
def group_members(spark, sf_dir):
    """The first three domains of each group of a skeleton: a row a domain first, then three of them."""
    once = hits(spark, sf_dir).select("sk", "fold", "domain").distinct()
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy("sk", "fold").orderBy("domain")))
    return ranked.groupBy("sk", "fold").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("domain")))), lambda x: x.cast("string")), ",").alias("members"))
