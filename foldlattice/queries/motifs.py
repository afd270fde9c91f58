"""Elements, contacts, geometry, motif searches and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.functions import codes as C
from foldlattice.functions import geometry as G
from foldlattice.operators.search import parity_of_sheets, search
from foldlattice.operators.sweep import sweep
from foldlattice.plans.motif import motif_sql, parse_motif

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TOPO, GEOM = f"WITH {X.TOPOLOGICAL_SQL} ", f"WITH {X.GEOMETRIC_SQL} "

#: Motifs over topological records (t...) and geometric records (g...).
TEXTS = {
    "t2": "1 2\nE E\n* x\n*",
    "t3": "1 2 3\nE E H\n* x X\n* C\n*\nlength 3 H 8 1000",
    "t4": "1 2 3 4\nE H E X\n* C X X\n* T X\n* x\n*",
    "t5": "1 2 3 4 5\nX X X X X\n* x X X X\n* C X X\n* T X\n* X\n*\nchainAll",
    "t3_any": "1 2 3\nX E X\n* x X\n* x\n*",
    "t3_free": "1 2 3\nE E H\n* x X\n* C\n*\nchainAll",
    "t3_chain_same": "1 2 3\nE X H\n* X X\n* x\n*\nchainS 1 3\nchainAll",
    "t3_chain_diff": "1 2 3\nE X H\n* X X\n* x\n*\nchainD 1 3",
    "t2_length": "1 2\nH E\n* X\n*\nlength 1 H 10 20\nlength 2 E 30 50",
    "g5": "1 2 3 4 5\nE E H E E\n* T X X X\n* T X X\n* x X\n* T\n*\nchainAll",
    "g3_sheet_same": "1 2 3\nE E E\n* x X\n* x\n*\nsheetS 1 2 3",
    "g3_sheet_diff": "1 2 3\nE H E\n* x X\n* x\n*\nsheet D 1 3",
    "g3_right": "1 2 3\nE H E\n* x X\n* x\n*\nhandedness 1 2 3 R",
    "g3_left": "1 2 3\nE H E\n* x X\n* x\n*\nhandedness 1 2 3 L",
}
MOTIFS = {name: parse_motif(name, text) for name, text in TEXTS.items()}
NAMES = {
    "t2": "motif_k2", "t3": "motif_k3", "t4": "motif_k4", "t5": "motif_k5_relaxed", "t3_any": "motif_type_any", "t3_free": "motif_chain_any", "t3_chain_same": "req_chain_same",
    "t3_chain_diff": "req_chain_diff", "t2_length": "req_length", "g5": "motif_k5_geometric", "g3_sheet_same": "req_sheet_same", "g3_sheet_diff": "req_sheet_diff", "g3_right": "req_handedness", "g3_left": "req_handedness_left",
}


def _add_motif(key: str, name: str) -> None:
    motif, topological = MOTIFS[key], key[0] == "t"
    sql = motif_sql(motif, *(("el2", "ct2") if topological else ("el1", "ct1", "sh1")), chirality=G.chirality)

    @query(name, (TOPO if topological else GEOM) + sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search((X.topological if topological else X.geometric)(spark, sf_dir), motif)


for _key, _name in NAMES.items():
    _add_motif(_key, _name)


@query("elements_lineitem", TOPO + "SELECT record_id, pos, etype, chain, length FROM el2")
def elements_lineitem(spark, sf_dir):
    return X.elements_of(X.topological(spark, sf_dir)).select("record_id", "pos", "etype", "chain", "length")


@query("elements_embeddings", GEOM + "SELECT record_id, pos, etype, chain, length, round(fx, 4) AS fx, round(lz, 4) AS lz FROM el1")
def elements_embeddings(spark, sf_dir):
    return X.elements_of(X.geometric(spark, sf_dir)).select("record_id", "pos", "etype", "chain", "length", F.round("fx", 4).alias("fx"), F.round("lz", 4).alias("lz"))


@query("contacts_long", TOPO + "SELECT record_id, i, j, code FROM ct2")
def contacts_long(spark, sf_dir):
    return X.contacts_of(X.topological(spark, sf_dir))


@query("interaction_code", GEOM + "SELECT record_id, i, j, code FROM ct1")
def interaction_code(spark, sf_dir):
    return X.contacts_of(X.geometric(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    records = X.geometric(spark, sf_dir)
    one = records.select("record_id", "elements", F.posexplode("elements").alias("i", "a"))
    return one.select("record_id", (F.col("i") + 1).alias("i"), "a", F.posexplode(F.expr("slice(elements, i + 2, 10)")).alias("d", "b")).withColumn("j", F.col("i") + F.col("d") + 1)


def _add_pair(name: str, column: str, expression) -> None:
    sql = f"SELECT a.record_id, a.pos AS i, b.pos AS j, round({expression('a', 'b')}, 5) AS {column} FROM el1 a JOIN el1 b ON a.record_id = b.record_id AND a.pos < b.pos"

    @query(name, GEOM + sql)
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("record_id", "i", "j", F.expr(f"round({expression('a', 'b')}, 5)").alias(column))


_add_pair("pair_angle", "angle", G.angle)
_add_pair("pair_overlap", "overlap", G.overlap)
_add_pair("pair_distance", "distance", G.distance)


@query("chirality_triples", GEOM + f"SELECT a.record_id, a.pos AS i, b.pos AS j, c.pos AS m, {G.chirality('a', 'b', 'c')} AS side FROM el1 a JOIN el1 b ON a.record_id = b.record_id AND a.pos < b.pos JOIN el1 c ON a.record_id = c.record_id AND b.pos < c.pos")
def chirality_triples(spark, sf_dir):
    return _pairs(spark, sf_dir).join(X.elements_of(X.geometric(spark, sf_dir)).select("record_id", F.col("pos").alias("m"), F.struct("fx", "fy", "fz", "lx", "ly", "lz").alias("c")), "record_id").where("m > j").select("record_id", "i", "j", "m", F.expr(G.chirality("a", "b", "c")).alias("side"))


@query("code_match_table", TOPO + f", held AS (SELECT code AS h, count(*) AS pairs FROM ct2 GROUP BY code) SELECT h AS held, w AS wanted, {C.code_matches('h', 'w')} AS ok, pairs FROM held, (SELECT unnest({list(C.QUERY_CODES)}) AS w)")
def code_match_table(spark, sf_dir):
    """Which of the records' codes each code of a motif accepts, with the number of pairs."""
    held = X.contacts_of(X.topological(spark, sf_dir)).groupBy(F.col("code").alias("held")).agg(F.count("*").alias("pairs"))
    wanted = F.explode(F.array(*map(F.lit, C.QUERY_CODES))).alias("wanted")
    return held.select("held", "pairs", wanted).select("held", "wanted", F.expr(C.code_matches("held", "wanted")).alias("ok"), "pairs")


SWEPT = ("t3_free", "t3_any")


def _swept_motifs():
    types = [a + b + c for a in "HE" for b in "HE" for c in "HE"]
    return [parse_motif(f"s-{t}-{n}", f"1 2 3\n{' '.join(t)}\n* {code} X\n* {code}\n*\nchainAll") for t in types for n, code in enumerate("xCT")]


_SWEEP_SQL = " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(m, 'el2', 'ct2')})" for m in _swept_motifs())


@query("motif_multi_query", TOPO + _SWEEP_SQL)
def motif_multi_query(spark, sf_dir):
    return sweep(X.topological(spark, sf_dir), _swept_motifs())


@query("hits_per_query", TOPO + f"SELECT query_id, count(DISTINCT record_id) AS records, count(*) AS hits FROM ({_SWEEP_SQL}) GROUP BY query_id")
def hits_per_query(spark, sf_dir):
    return motif_multi_query(spark, sf_dir).groupBy("query_id").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("hits"))


@query("distinct_hitters", TOPO + f"SELECT count(DISTINCT record_id) AS distinct_records, count(DISTINCT (query_id, record_id)) AS incidences FROM ({_SWEEP_SQL})")
def distinct_hitters(spark, sf_dir):
    return motif_multi_query(spark, sf_dir).agg(F.countDistinct("record_id").alias("distinct_records"), F.countDistinct("query_id", "record_id").alias("incidences"))


def _parity_sql(name: str, t: int) -> str:
    """Walks of up to nine contacts; a pair's shortest ones decide, fewer t's first."""
    paths = """, edge AS (SELECT record_id, i AS a, j AS b, CASE code WHEN 't' THEN 1 ELSE 0 END AS t FROM ct1 WHERE code IN ('c', 't')),
both_ways AS (SELECT record_id, a, b, t FROM edge UNION ALL SELECT record_id, b, a, t FROM edge),
walk AS (SELECT record_id, a, b, t, 1 AS d FROM both_ways UNION SELECT w.record_id, w.a, e.b, (w.t + e.t) % 2, w.d + 1 FROM walk w JOIN both_ways e ON w.record_id = e.record_id AND w.b = e.a WHERE w.d < 9 AND w.a <> e.b),
par AS (SELECT record_id, a, b, arg_min(t, 2 * d + t) AS t FROM walk WHERE a < b GROUP BY record_id, a, b)"""
    return f"WITH RECURSIVE {X.GEOMETRIC_SQL}{paths} SELECT '{name}' AS query_id, record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY a DESC, b DESC) AS INTEGER) AS motif_idx, CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) AS positions FROM par WHERE t = {t}"


def _add_parity(name: str, kind: str, t: int) -> None:
    motif = parse_motif(name, f"1 2\nE E\n* X\n*\n{kind} 1 2\nchainAll")

    @query(name, _parity_sql(name, t))
    def run(spark, sf_dir):
        return search(parity_of_sheets(X.geometric(spark, sf_dir)), motif)


_add_parity("req_parallel", "parallel", 0)
_add_parity("req_antiparallel", "antiparallel", 1)


@query("strand_degree", GEOM + "SELECT record_id, pos, count(*) AS partners FROM (SELECT record_id, i AS pos FROM ct1 WHERE code IN ('c', 't') UNION ALL SELECT record_id, j FROM ct1 WHERE code IN ('c', 't')) GROUP BY record_id, pos")
def strand_degree(spark, sf_dir):
    bonded = interaction_code(spark, sf_dir).where("code IN ('c', 't')")
    return bonded.select("record_id", F.explode(F.array("i", "j")).alias("pos")).groupBy("record_id", "pos").agg(F.count("*").alias("partners"))


@query("sheet_edge_strands", GEOM + "SELECT record_id, pos FROM (SELECT record_id, i AS pos FROM ct1 WHERE code IN ('c', 't') UNION ALL SELECT record_id, j FROM ct1 WHERE code IN ('c', 't')) GROUP BY record_id, pos HAVING count(*) = 1")
def sheet_edge_strands(spark, sf_dir):
    return strand_degree(spark, sf_dir).where("partners = 1").select("record_id", "pos")


@query("unpaired_strands", GEOM + "SELECT e.record_id, e.pos FROM el1 e WHERE e.etype = 'E' AND NOT EXISTS (SELECT 1 FROM ct1 c WHERE c.record_id = e.record_id AND c.code IN ('c', 't') AND e.pos IN (c.i, c.j))")
def unpaired_strands(spark, sf_dir):
    records = X.geometric(spark, sf_dir)
    strands = X.elements_of(records).where("etype = 'E'").select("record_id", "pos")
    return strands.join(strand_degree(spark, sf_dir), ["record_id", "pos"], "left_anti")


@query("eligibility_funnel", TOPO + """, s AS (SELECT record_id, count(*) AS n, count(*) FILTER (WHERE (etype = 'H' AND length >= 8) OR (etype = 'E' AND length >= 5)) AS fit FROM el2 GROUP BY record_id)
SELECT CASE WHEN n < 5 THEN 'A' WHEN fit < 5 THEN 'B' ELSE 'CD' END AS class, count(*) AS records, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1""")
def eligibility_funnel(spark, sf_dir):
    records = X.topological(spark, sf_dir).select("n", F.expr("size(filter(elements, e -> (e.etype = 'H' AND e.length >= 8) OR (e.etype = 'E' AND e.length >= 5)))").alias("fit"))
    label = F.when(F.col("n") < 5, "A").when(F.col("fit") < 5, "B").otherwise("CD").alias("class")
    counts = records.groupBy(label).agg(F.count("*").alias("records"))
    whole = records.agg(F.count("*").alias("whole"))
    return counts.crossJoin(whole).select("class", "records", F.round(F.col("records") / F.col("whole"), 6).alias("share"))
