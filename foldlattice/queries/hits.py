"""Hit analytics: grids of cells, groups per cell, time series, agreement and joins over hits.

Orders stand for hits: the order is a record, its customer a domain, nation and region are fold
groups, the date is the deposition date, status the source and segment the method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.fixtures import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: A hit's cell: skeleton and typing of its grid.
SK, TY = "CAST(o_orderkey % 20 AS INTEGER)", "CAST(floor(o_orderkey / 20) AS BIGINT) % 8"
HITS = f"""WITH hits AS (SELECT o_orderkey AS record, o_custkey AS domain, {SK} AS sk, {TY} AS ty, CAST(n_nationkey AS INTEGER) AS fold, CAST(n_regionkey AS INTEGER) AS hgroup,
  year(o_orderdate) AS year, o_orderstatus AS source, c_mktsegment AS method, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) """


def hits(spark, sf_dir) -> DataFrame:
    """Hits with their classification; small tables are joined as Spark sees fit by their sizes."""
    orders = read(spark, sf_dir, "orders")
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("domain"), (F.col("o_orderkey") % 20).cast("int").alias("sk"), (F.floor(F.col("o_orderkey") / 20) % 8).cast("long").alias("ty"),
        F.col("n_nationkey").cast("int").alias("fold"), F.col("n_regionkey").cast("int").alias("hgroup"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("source"), F.col("c_mktsegment").alias("method"), F.col("o_totalprice").alias("value"),
    )


@query("cell_grid", HITS + "SELECT sk, ty, count(DISTINCT fold) AS n_folds, count(DISTINCT hgroup) AS n_hgroups, count(DISTINCT domain) AS n_domains, count(*) AS n_hits FROM hits GROUP BY sk, ty")
def cell_grid(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "ty").agg(F.countDistinct("fold").alias("n_folds"), F.countDistinct("hgroup").alias("n_hgroups"), F.countDistinct("domain").alias("n_domains"), F.count("*").alias("n_hits"))


@query("cell_rollup", HITS + "SELECT coalesce(CAST(hgroup AS VARCHAR), 'all') AS hgroup, coalesce(CAST(sk AS VARCHAR), 'all') AS sk, count(*) AS n_hits, count(DISTINCT fold) AS n_folds FROM hits GROUP BY ROLLUP (hgroup, sk)")
def cell_rollup(spark, sf_dir):
    rolled = hits(spark, sf_dir).rollup("hgroup", "sk").agg(F.count("*").alias("n_hits"), F.countDistinct("fold").alias("n_folds"))
    return rolled.select(*[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("hgroup", "sk")], "n_hits", "n_folds")


@query("cell_promiscuity", HITS + "SELECT sk, ty, year, count(DISTINCT fold) AS n_folds, count(DISTINCT fold) = 1 AS unitypical FROM hits GROUP BY sk, ty, year")
def cell_promiscuity(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "ty", "year").agg(F.countDistinct("fold").alias("n_folds")).withColumn("unitypical", F.col("n_folds") == 1)


_BUCKET = "CASE WHEN {n} = 1 THEN '1' WHEN {n} = 2 THEN '2' WHEN {n} <= 5 THEN '3-5' WHEN {n} <= 10 THEN '6-10' WHEN {n} <= 20 THEN '11-20' WHEN {n} <= 50 THEN '21-50' ELSE '51+' END"


@query("unitypical_histogram", HITS + f"SELECT {_BUCKET.format(n='n')} AS bucket, count(*) AS cells FROM (SELECT count(DISTINCT fold) AS n FROM hits GROUP BY sk, ty) GROUP BY 1")
def unitypical_histogram(spark, sf_dir):
    return cell_grid(spark, sf_dir).groupBy(F.expr(_BUCKET.format(n="n_folds")).alias("bucket")).agg(F.count("*").alias("cells"))


@query("top_groups_per_cell", HITS + """, g AS (SELECT sk, ty, fold, count(*) AS n, min(CASE WHEN source = 'F' THEN record END) AS first_f, min(record) AS first_any FROM hits GROUP BY sk, ty, fold)
SELECT sk, ty, fold, n, coalesce(first_f, first_any) AS exemplar, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sk, ty ORDER BY n DESC, fold) AS INTEGER) AS rank FROM g) WHERE rank <= 3""")
def top_groups_per_cell(spark, sf_dir):
    groups = hits(spark, sf_dir).groupBy("sk", "ty", "fold").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("source") == "F", F.col("record"))), F.min("record")).alias("exemplar"))
    return groups.withColumn("rank", F.row_number().over(W.partitionBy("sk", "ty").orderBy(F.desc("n"), "fold"))).where("rank <= 3")


@query("composition_coverage", HITS + "SELECT bit_count(ty) AS strands, count(DISTINCT (sk, ty)) AS cells, count(DISTINCT fold) AS folds FROM hits GROUP BY 1")
def composition_coverage(spark, sf_dir):
    return hits(spark, sf_dir).groupBy(F.bit_count("ty").alias("strands")).agg(F.countDistinct("sk", "ty").alias("cells"), F.countDistinct("fold").alias("folds"))


@query("cell_year_increments", HITS + "SELECT sk, year, count(DISTINCT domain) AS domains FROM hits GROUP BY sk, year")
def cell_year_increments(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "year").agg(F.countDistinct("domain").alias("domains"))


@query("first_appearance", HITS + "SELECT sk, ty, min(year) AS first_year FROM hits GROUP BY sk, ty")
def first_appearance(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("sk", "ty").agg(F.min("year").alias("first_year"))


@query("occupancy_curve", HITS + """, f AS (SELECT sk, ty, fold, min(year) AS y FROM hits GROUP BY sk, ty, fold), a AS (SELECT unnest(range((SELECT min(year) FROM hits), (SELECT max(year) FROM hits) + 1)) AS year)
SELECT CAST(a.year AS INTEGER) AS year, count(f.y) AS new_folds, CAST(sum(count(f.y)) OVER (ORDER BY a.year) AS BIGINT) AS total FROM a LEFT JOIN f ON a.year = f.y GROUP BY a.year""")
def occupancy_curve(spark, sf_dir):
    own = hits(spark, sf_dir)
    first = own.groupBy("sk", "ty", "fold").agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    axis = own.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    # one row a year meets in the running sum
    return axis.join(first, "year", "left").select("year", F.coalesce("n", F.lit(0).cast("long")).alias("new_folds")).withColumn("total", F.sum("new_folds").over(W.orderBy("year")))


@query("vintage_fill_rate", HITS + """, f AS (SELECT sk, ty, fold, min(year) AS y FROM hits GROUP BY sk, ty, fold)
SELECT CAST(v AS INTEGER) AS vintage, count(*) FILTER (WHERE y <= v) AS lit, round(count(*) FILTER (WHERE y <= v) / 4000.0, 6) AS fill FROM f, (SELECT unnest([1992, 1994, 1996, 1998]) AS v) GROUP BY v""")
def vintage_fill_rate(spark, sf_dir):
    first = hits(spark, sf_dir).groupBy("sk", "ty", "fold").agg(F.min("year").alias("y"))
    lit = first.select("y", F.explode(F.array(*[F.lit(v) for v in (1992, 1994, 1996, 1998)])).alias("vintage")).groupBy("vintage").agg(F.count_if(F.col("y") <= F.col("vintage")).alias("lit"))
    return lit.withColumn("fill", F.round(F.col("lit") / 4000.0, 6))


@query("cell_year_totals", HITS + """, y AS (SELECT unnest(generate_series((SELECT min(year) FROM hits), (SELECT max(year) FROM hits))) AS year), c AS (SELECT DISTINCT sk FROM hits),
n AS (SELECT sk, year, count(*) AS n FROM hits GROUP BY 1, 2), f AS (SELECT sk, year, count(*) AS n FROM (SELECT sk, domain, min(year) AS year FROM hits GROUP BY 1, 2) GROUP BY 1, 2)
SELECT c.sk, CAST(y.year AS INTEGER) AS year, coalesce(n.n, 0) AS hits, CAST(sum(coalesce(n.n, 0)) OVER w AS BIGINT) AS total, CAST(sum(coalesce(f.n, 0)) OVER w AS BIGINT) AS domains
FROM c CROSS JOIN y LEFT JOIN n ON n.sk = c.sk AND n.year = y.year LEFT JOIN f ON f.sk = c.sk AND f.year = y.year WINDOW w AS (PARTITION BY c.sk ORDER BY y.year)""")
def cell_year_totals(spark, sf_dir):
    """Each cell's hits a year over all years, also those without, with running totals of hits and of domains seen so far."""
    own = hits(spark, sf_dir).select("sk", "year", "domain")
    axis = own.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    first = own.groupBy("sk", "domain").agg(F.min("year").alias("year")).groupBy("sk", "year").agg(F.count("*").alias("new"))
    years = own.groupBy("sk", "year").agg(F.count("*").alias("hits"))
    dense = own.select("sk").distinct().join(F.broadcast(axis)).select("sk", F.explode(F.sequence("first", "last")).alias("year"))
    upto = W.partitionBy("sk").orderBy("year").rowsBetween(W.unboundedPreceding, 0)  # years of a cell
    told = dense.join(years, ["sk", "year"], "left").join(first, ["sk", "year"], "left").fillna(0, ["hits", "new"])
    return told.select("sk", "year", "hits", F.sum("hits").over(upto).alias("total"), F.sum("new").over(upto).alias("domains"))


@query("overlap_argmax", """WITH seg AS (SELECT l_orderkey AS hit, CAST(l_linenumber * 10 AS BIGINT) AS lo, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS hi FROM lineitem),
dom AS (SELECT o_orderkey AS hit, d AS dom, CAST(d * 25 + o_custkey % 10 AS BIGINT) AS lo, CAST(d * 25 + o_custkey % 10 + 24 AS BIGINT) AS hi FROM orders, range(4) r(d)),
o AS (SELECT seg.hit, dom.dom, sum(greatest(0, least(seg.hi, dom.hi) - greatest(seg.lo, dom.lo) + 1)) AS shared FROM seg JOIN dom ON seg.hit = dom.hit GROUP BY 1, 2)
SELECT hit, CAST(dom AS INTEGER) AS dom, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY shared DESC, dom) AS r FROM o WHERE shared > 0) WHERE r = 1""")
def overlap_argmax(spark, sf_dir):
    """Each hit's domain of largest overlap, the first of equals; none without overlap."""
    seg = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hit"), (F.col("l_linenumber") * 10).cast("long").alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("hi"))
    dom = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("dom"), "o_custkey").select("hit", "dom", (F.col("dom") * 25 + F.col("o_custkey") % 10).alias("dlo"), (F.col("dom") * 25 + F.col("o_custkey") % 10 + 24).alias("dhi"))
    shared = F.sum(F.greatest(F.lit(0), F.least("hi", "dhi") - F.greatest("lo", "dlo") + 1)).alias("shared")
    per = seg.join(dom, "hit").groupBy("hit", "dom").agg(shared).where("shared > 0")
    return per.groupBy("hit").agg(F.max_by(F.struct("dom", "shared"), F.struct("shared", -F.col("dom"))).alias("b")).select("hit", "b.dom", "b.shared")


@query("majority_domain", """WITH seg AS (SELECT l_orderkey AS hit, l_linenumber AS dom, CAST(l_quantity AS BIGINT) AS n FROM lineitem), t AS (SELECT hit, dom, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY hit) AS whole FROM seg GROUP BY hit, dom)
SELECT hit, CAST(min(dom) AS INTEGER) AS dom FROM t WHERE 2 * n > whole GROUP BY hit""")
def majority_domain(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hit"), F.col("l_linenumber").alias("dom")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return own.withColumn("whole", F.sum("n").over(W.partitionBy("hit"))).where("2 * n > whole").groupBy("hit").agg(F.min("dom").alias("dom"))


@query("one_to_one_pairs", """WITH a AS (SELECT c_nationkey AS k, max(c_custkey) AS a FROM customer WHERE c_acctbal > 9800 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT s_nationkey AS k, max(s_suppkey) AS b FROM supplier GROUP BY 1 HAVING count(*) FILTER (WHERE s_acctbal > 7000) = 1)
SELECT CAST(a.k AS INTEGER) AS k, a, b FROM a JOIN b ON a.k = b.k""")
def one_to_one_pairs(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9800").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("a")).where("n = 1")
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count_if(F.col("s_acctbal") > 7000).alias("m"), F.max("s_suppkey").alias("b")).where("m = 1")
    return a.join(b, "k").select("k", "a", "b")


@query("recursive_descent", """WITH RECURSIVE d AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, d.depth + 1 FROM d JOIN part p ON CAST(floor(p.p_partkey / 3) AS BIGINT) = d.id WHERE p.p_partkey > 1)
SELECT id, CAST(depth AS INTEGER) AS depth FROM d""")
def recursive_descent(spark, sf_dir):
    """All parts below part 1, where part p hangs below floor(p / 3)."""
    parts = read(spark, sf_dir, "part").select("p_partkey")
    return spark.sql("""WITH RECURSIVE d(id, depth) AS (SELECT p_partkey, 0 FROM {parts} WHERE p_partkey = 1 UNION ALL
        SELECT p.p_partkey, d.depth + 1 FROM d JOIN {parts} p ON floor(p.p_partkey / 3) = d.id WHERE p.p_partkey > 1) SELECT id, depth FROM d""", parts=parts)


@query("missing_chunks_anti", "SELECT p_partkey AS chunk FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def missing_chunks_anti(spark, sf_dir):
    have = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("chunk"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk")).join(have, "chunk", "left_anti")


_QUADRANT = "CASE WHEN coalesce({a}, 0) = 0 AND coalesce({b}, 0) = 0 THEN 'truly_absent' WHEN coalesce({a}, 0) = 0 THEN 'only_b' WHEN coalesce({b}, 0) = 0 THEN 'loss' ELSE 'common' END"


@query("quadrants", HITS + f""", g AS (SELECT s AS sk, t AS ty FROM range(20) a(s), range(8) b(t)), a AS (SELECT sk, ty, count(*) AS n FROM hits WHERE source = 'P' GROUP BY 1, 2), b AS (SELECT sk, ty, count(*) AS n FROM hits WHERE source = 'F' GROUP BY 1, 2)
SELECT CAST(g.sk AS INTEGER) AS sk, g.ty, {_QUADRANT.format(a="a.n", b="b.n")} AS quadrant FROM g LEFT JOIN a ON g.sk = a.sk AND g.ty = a.ty LEFT JOIN b ON g.sk = b.sk AND g.ty = b.ty""")
def quadrants(spark, sf_dir):
    own = hits(spark, sf_dir).groupBy("sk", "ty").agg(F.count_if(F.col("source") == "P").alias("a"), F.count_if(F.col("source") == "F").alias("b"))
    grid = spark.range(160).select((F.col("id") % 20).cast("int").alias("sk"), F.floor(F.col("id") / 20).cast("long").alias("ty"))
    return grid.join(own, ["sk", "ty"], "left").select("sk", "ty", F.expr(_QUADRANT.format(a="a", b="b")).alias("quadrant"))


@query("under_templated", HITS + "SELECT sk, ty, count(*) FILTER (WHERE source = 'P') AS a, count(*) FILTER (WHERE source <> 'P') AS b FROM hits GROUP BY sk, ty HAVING count(*) FILTER (WHERE source = 'P') <= 30 AND count(*) FILTER (WHERE source <> 'P') >= 50")
def under_templated(spark, sf_dir):
    p = F.col("source") == "P"
    return hits(spark, sf_dir).groupBy("sk", "ty").agg(F.count_if(p).alias("a"), F.count_if(~p).alias("b")).where("a <= 30 AND b >= 50")


@query("saturation_sharing_jaccard", HITS + """, c AS (SELECT sk, domain, bool_or(source = 'P') AS a, bool_or(source = 'F') AS b FROM hits GROUP BY sk, domain)
SELECT sk, count(*) FILTER (WHERE a) AS in_a, count(*) FILTER (WHERE b) AS in_b, round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0), 6) AS jaccard FROM c GROUP BY sk""")
def saturation_sharing_jaccard(spark, sf_dir):
    c = hits(spark, sf_dir).groupBy("sk", "domain").agg(F.bool_or(F.col("source") == "P").alias("a"), F.bool_or(F.col("source") == "F").alias("b"))
    return c.groupBy("sk").agg(F.count_if("a").alias("in_a"), F.count_if("b").alias("in_b"), F.round(F.try_divide(F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))), 6).alias("jaccard"))


@query("paired_jaccard", HITS + """, s AS (SELECT domain, sk, bool_or(source = 'P' ) AS a, bool_or(source <> 'P') AS b FROM hits GROUP BY 1, 2), j AS (SELECT domain, count(*) FILTER (WHERE a AND b) / count(*) AS j, count(*) FILTER (WHERE a AND NOT b) AS oa, count(*) FILTER (WHERE b AND NOT a) AS ob FROM s GROUP BY domain)
SELECT count(*) AS pairs, round(avg(CASE WHEN j = 1 THEN 1.0 ELSE 0.0 END), 6) AS exact_share, round(avg(j), 6) AS mean_jaccard, round(median(j), 6) AS median_jaccard, CAST(sum(oa) AS BIGINT) AS only_a, CAST(sum(ob) AS BIGINT) AS only_b FROM j""")
def paired_jaccard(spark, sf_dir):
    s = hits(spark, sf_dir).groupBy("domain", "sk").agg(F.bool_or(F.col("source") == "P").alias("a"), F.bool_or(F.col("source") != "P").alias("b"))
    j = s.groupBy("domain").agg((F.count_if(F.col("a") & F.col("b")) / F.count("*")).alias("j"), F.count_if(F.col("a") & ~F.col("b")).alias("oa"), F.count_if(F.col("b") & ~F.col("a")).alias("ob"))
    return j.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("j") == 1).cast("double")), 6).alias("exact_share"), F.round(F.avg("j"), 6).alias("mean_jaccard"), F.round(F.percentile("j", 0.5), 6).alias("median_jaccard"), F.sum("oa").alias("only_a"), F.sum("ob").alias("only_b"))


@query("fold_category_share", HITS + ", f AS (SELECT fold, bool_or(method = 'BUILDING' AND value > 440000) AS any_b FROM hits GROUP BY fold) SELECT count(*) AS folds, count(*) FILTER (WHERE any_b) AS with_b, round(count(*) FILTER (WHERE any_b) / count(*), 6) AS share FROM f")
def fold_category_share(spark, sf_dir):
    f = hits(spark, sf_dir).groupBy("fold").agg(F.bool_or((F.col("method") == "BUILDING") & (F.col("value") > 440000)).alias("any_b"))
    return f.agg(F.count("*").alias("folds"), F.count_if("any_b").alias("with_b"), F.round(F.count_if("any_b") / F.count("*"), 6).alias("share"))


@query("expected_rates", HITS + """, g AS (SELECT hgroup, count(*) AS n, avg(CASE WHEN source = 'P' THEN 1.0 ELSE 0.0 END) AS rate FROM hits GROUP BY hgroup), w AS (SELECT avg(CASE WHEN source = 'P' THEN 1.0 ELSE 0.0 END) AS rate FROM hits)
SELECT sk, count(*) FILTER (WHERE source = 'P') AS observed, round(sum(CASE WHEN g.n < 5 THEN w.rate ELSE g.rate END), 4) AS expected FROM hits JOIN g USING (hgroup), w GROUP BY sk""")
def expected_rates(spark, sf_dir):
    """Observed against expected hits of one source by skeleton, from group rates; the global rate for small groups."""
    own = hits(spark, sf_dir)
    p = (F.col("source") == "P").cast("double")
    whole = own.agg(F.avg(p).alias("all_rate"))
    rates = own.groupBy("hgroup").agg(F.count("*").alias("n"), F.avg(p).alias("rate")).crossJoin(whole).select("hgroup", F.when(F.col("n") < 5, F.col("all_rate")).otherwise(F.col("rate")).alias("rate"))
    return own.join(rates, "hgroup").groupBy("sk").agg(F.count_if(F.col("source") == "P").alias("observed"), F.round(F.sum("rate"), 4).alias("expected"))


@query("set_algebra", HITS + """, a AS (SELECT DISTINCT sk, ty, fold FROM hits WHERE source = 'P'), b AS (SELECT DISTINCT sk, ty, fold FROM hits WHERE source = 'F')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_algebra(spark, sf_dir):
    own = hits(spark, sf_dir)
    a, b = (own.where(F.col("source") == s).select("sk", "ty", "fold").distinct() for s in "PF")
    made = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.subtract(a)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in made.items()]
    return parts[0].union(parts[1]).union(parts[2])
