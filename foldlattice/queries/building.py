"""Building elements from residues: vectors stand for chains of 21 residues in three elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.functions import geometry as G
from foldlattice.operators import builder as B
from foldlattice.operators.search import parity_of_sheets
from foldlattice.operators.spread import cell_spread
from foldlattice.sources import ssd
from foldlattice.queries.motifs import _parity_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RESIDUES = """WITH res AS (SELECT vec_id AS record_id, 'A' AS chain, CAST(i + 1 AS INTEGER) AS idx, CAST(embedding[3 * i + 1] AS DOUBLE) * 40 AS x, CAST(embedding[3 * i + 2] AS DOUBLE) * 40 AS y, CAST(embedding[3 * i + 3] AS DOUBLE) * 40 AS z FROM embeddings, range(21) r(i)),
els AS (SELECT vec_id AS record_id, CAST(e + 1 AS INTEGER) AS pos, CASE WHEN (vec_id + e) % 3 = 0 THEN 'H' ELSE 'E' END AS etype, 'A' AS chain, CAST(1 + 7 * e AS INTEGER) AS begin_idx, CAST(7 * e + 7 + CASE WHEN e < 2 THEN vec_id % 2 ELSE 0 END AS INTEGER) AS end_idx FROM embeddings, range(3) r(e)),
held AS (SELECT els.record_id, els.pos, els.etype, res.idx, res.x, res.y, res.z FROM els JOIN res ON els.record_id = res.record_id AND els.chain = res.chain AND res.idx BETWEEN els.begin_idx AND els.end_idx)"""


def _residues(spark, sf_dir):
    point = "transform(sequence(0, 20), i -> named_struct('idx', i + 1, " + ", ".join(f"'{c}', cast(embedding[3 * i + {k}] as double) * 40e0" for k, c in enumerate("xyz")) + "))"
    return X.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.lit("A").alias("chain"), F.explode(F.expr(point)).alias("p")).select("record_id", "chain", "p.*")


def _elements(spark, sf_dir):
    own = X.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("e"))
    return own.selectExpr("record_id", "e + 1 AS pos", "CASE WHEN (record_id + e) % 3 = 0 THEN 'H' ELSE 'E' END AS etype", "'A' AS chain", "1 + 7 * e AS begin_idx", "cast(7 * e + 7 + CASE WHEN e < 2 THEN record_id % 2 ELSE 0 END as int) AS end_idx")


def _held(spark, sf_dir):
    return B.residues_of(_elements(spark, sf_dir), _residues(spark, sf_dir))


@query("residue_element_join", RESIDUES + " SELECT record_id, pos, etype, count(*) AS n, min(idx) AS first, max(idx) AS last, round(avg(x), 5) AS cx FROM held GROUP BY record_id, pos, etype")
def residue_element_join(spark, sf_dir):
    return _held(spark, sf_dir).groupBy("record_id", "pos", "etype").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.round(F.avg("x"), 5).alias("cx"))


_AT = "max(CASE WHEN k = {k} THEN {c} END)"


def _strand_sql() -> str:
    """Strands of seven or eight residues: midpoints 2|3 and n-2|n-1, projections of 1 and n."""
    near = {c: f"({_AT.format(k=2, c=c)} + {_AT.format(k=3, c=c)}) / 2" for c in "xyz"}
    far = {c: f"({_AT.format(k='n - 2', c=c)} + {_AT.format(k='n - 1', c=c)}) / 2" for c in "xyz"}
    cols = ", ".join(f"{near[c]} AS u{c}, {far[c]} AS w{c}, {_AT.format(k=1, c=c)} AS p{c}, {_AT.format(k='n', c=c)} AS q{c}" for c in "xyz")
    size = "((wx - ux) * (wx - ux) + (wy - uy) * (wy - uy) + (wz - uz) * (wz - uz))"

    def along(p: str) -> str:
        return "(" + " + ".join(f"({p}{c} - u{c}) * (w{c} - u{c})" for c in "xyz") + f") / {size}"

    out = ", ".join(f"round(u{c} + {along(p)} * (w{c} - u{c}), 5) AS {e}{c}" for e, p in (("f", "p"), ("l", "q")) for c in "xyz")
    return f", o AS (SELECT *, row_number() OVER (PARTITION BY record_id, pos ORDER BY idx) AS k, count(*) OVER (PARTITION BY record_id, pos) AS n FROM held WHERE etype = 'E'), m AS (SELECT record_id, pos, {cols} FROM o GROUP BY record_id, pos) SELECT record_id, pos, {out} FROM m"


@query("strand_axis", RESIDUES + _strand_sql())
def strand_axis(spark, sf_dir):
    axes = B.strand_axes(_held(spark, sf_dir).where("etype = 'E'"))
    return axes.select("record_id", "pos", *[F.round(f"{e}{c}", 5).alias(f"{e}{c}") for e in "fl" for c in "xyz"])


@query("helix_axis")
def helix_axis(spark, sf_dir):
    return B.helix_axes(_held(spark, sf_dir).where("etype = 'H'"))


_BONDED = "(r.record_id + {a} * {b}) % 11 = 0 AND abs({a} - {b}) > 3"


@query("hbond_orientation", RESIDUES + """, hb AS (SELECT a.record_id, a.idx AS a, b.idx AS b FROM res a JOIN res b ON a.record_id = b.record_id AND (a.record_id + a.idx * b.idx) % 11 = 0 AND abs(a.idx - b.idx) > 3),
p AS (SELECT s.record_id, s.pos AS i, t.pos AS j, hb.a, hb.b FROM held s JOIN hb ON hb.record_id = s.record_id AND hb.a = s.idx JOIN held t ON t.record_id = hb.record_id AND t.idx = hb.b WHERE s.etype = 'E' AND t.etype = 'E' AND s.pos < t.pos)
SELECT record_id, i, j, count(*) AS bonds, CASE WHEN arg_min(b, a * 100 + b) > arg_max(b, a * 100 + b) THEN 't' ELSE 'c' END AS code FROM p GROUP BY record_id, i, j HAVING count(*) >= 2""")
def hbond_orientation(spark, sf_dir):
    r = _residues(spark, sf_dir).groupBy("record_id").agg(F.sort_array(F.collect_set("idx")).alias("ids"))  # 21 a record
    pairs = r.select("record_id", "ids", F.explode("ids").alias("a")).select("record_id", "a", F.explode("ids").alias("b")).where("(record_id + a * b) % 11 = 0 AND abs(a - b) > 3")
    return B.strand_bonds(_held(spark, sf_dir), pairs)


@query("element_gaps", RESIDUES + " SELECT record_id, i, j, round(gap, 5) AS gap FROM (SELECT p.record_id, p.pos AS i, q.pos AS j, sqrt(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) AS gap FROM held p JOIN held q ON p.record_id = q.record_id AND p.pos < q.pos GROUP BY ALL) WHERE gap <= 11")
def element_gaps(spark, sf_dir):
    """Least residue distances of elements in reach of each other, by cells of space."""
    return B.near_elements(_held(spark, sf_dir)).select("record_id", "i", "j", F.round("gap", 5).alias("gap"))


@query("element_filter", f"WITH {X.TOPOLOGICAL_SQL} SELECT record_id, pos, etype, length FROM el2 WHERE (etype = 'H' AND length >= 5) OR (etype = 'E' AND length >= 2) OR (etype = 'L' AND length >= 3)")
def element_filter(spark, sf_dir):
    return B.keep_elements(X.elements_of(X.topological(spark, sf_dir)).select("record_id", "pos", "etype", "length"))


@query("sheet_components", _parity_sql("x", 0).split(" SELECT 'x'")[0] + " SELECT record_id, b AS pos, min(a) AS sheet FROM par GROUP BY record_id, b")
def sheet_components(spark, sf_dir):
    """For each strand but the first of its sheet, the first strand that contacts lead to."""
    pairs = parity_of_sheets(X.geometric(spark, sf_dir)).select("record_id", F.explode("parity").alias("p")).select("record_id", F.split(F.split("p", "=")[0], "-").alias("ij"))
    return pairs.select("record_id", F.col("ij")[0].cast("int").alias("i"), F.col("ij")[1].cast("int").alias("pos")).groupBy("record_id", "pos").agg(F.min("i").alias("sheet"))


def _cards(spark, sf_dir):
    """Card text of every vector: three elements of its 21 residues, the later strands of every third one marked, and their bonds."""
    base = X.read(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(sequence(0, 20), i -> named_struct('i', i + 1, " + ", ".join(f"'{c}', cast(embedding[3 * i + {k}] as double) * 40e0" for k, c in enumerate("xyz")) + ")) AS p")
    ids = "sequence(1, 21)"
    atoms = "transform(p, q -> format_string('ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f', q.i, q.i, q.x, q.y, q.z))"
    ends = "(7 * e + 7 + CASE WHEN e < 2 THEN vec_id % 2 ELSE 0 END)"
    strand = f"concat(rpad(concat('SHEET      ', lpad(concat('S', e % 2), 3, ' '), repeat(' ', 7), 'A', lpad(1 + 7 * e, 4, ' ')), 33, ' '), lpad({ends}, 4, ' '), repeat(' ', 33), CASE WHEN e = 2 AND vec_id % 3 = 1 THEN 'm' ELSE ' ' END, lpad({ends} - 7 * e, 5, ' '))"
    linker = f"concat(rpad(concat('LINKER', repeat(' ', 13), 'A ', lpad(1 + 7 * e, 4, ' ')), 31, ' '), 'A ', lpad({ends}, 4, ' '), repeat(' ', 34), lpad({ends} - 7 * e, 5, ' '))"
    cards = f"transform(sequence(0, 2), e -> CASE WHEN (vec_id + e) % 3 = 0 THEN {linker} ELSE {strand} END)"
    bonds = f"flatten(transform({ids}, a -> transform(filter({ids}, b -> (vec_id + a * b) % 11 = 0 AND b - a > 3), b -> concat('PAIRS  ', lpad('1', 6, ' '), repeat(' ', 6), 'A ', lpad(a, 4, ' '), repeat(' ', 6), 'A ', lpad(b, 4, ' ')))))"
    return base.select(F.col("vec_id").cast("string").alias("file"), F.posexplode(F.expr(f"concat({cards}, {bonds}, {atoms})")).alias("at", "line"))


def _built_sql() -> str:
    res = RESIDUES.replace("* 40 AS x", "* 40 AS x0").replace("* 40 AS y", "* 40 AS y0").replace("* 40 AS z", "* 40 AS z0").replace("WITH res AS (SELECT", "WITH raw AS (SELECT", 1)
    res = res.replace("range(21) r(i)),", "range(21) r(i)), res AS (SELECT record_id, chain, idx, round(x0, 3) AS x, round(y0, 3) AS y, round(z0, 3) AS z FROM raw),", 1).replace("THEN 'H' ELSE 'E' END AS etype", "THEN 'L' ELSE 'E' END AS etype")
    axes = _strand_sql().replace(" WHERE etype = 'E'", "").replace("round(", "(").replace(", 5) AS", ") AS")
    axes, tail = axes.rsplit(" SELECT record_id, pos,", 1)
    el = f", el AS (SELECT record_id, pos,{tail}), ax AS (SELECT el.*, els.etype, CASE WHEN els.etype = 'E' THEN (els.pos - 1) % 2 END AS sheet FROM el JOIN els USING (record_id, pos))"
    gap = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in "xyz")
    return res + axes + el + f""", gp AS (SELECT p.record_id, p.pos AS i, q.pos AS j, least(1000.0, sqrt(min({gap}))) AS gap FROM held p JOIN held q ON p.record_id = q.record_id AND p.pos < q.pos GROUP BY 1, 2, 3),
mk AS (SELECT record_id, begin_idx, end_idx FROM els WHERE etype = 'E' AND pos = 3 AND record_id % 3 = 1),
hb AS (SELECT a.record_id, a.idx AS a, b.idx AS b FROM res a JOIN res b ON a.record_id = b.record_id AND (a.record_id + a.idx * b.idx) % 11 = 0 AND abs(a.idx - b.idx) > 3 WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.record_id = a.record_id AND (a.idx BETWEEN begin_idx AND end_idx OR b.idx BETWEEN begin_idx AND end_idx))),
hp AS (SELECT s.record_id, s.pos AS i, t.pos AS j, hb.a, hb.b FROM held s JOIN hb ON hb.record_id = s.record_id AND hb.a = s.idx JOIN held t ON t.record_id = hb.record_id AND t.idx = hb.b WHERE s.etype = 'E' AND t.etype = 'E' AND s.pos < t.pos),
bd AS (SELECT record_id, i, j, CASE WHEN arg_min(b, a * 100 + b) > arg_max(b, a * 100 + b) THEN 't' ELSE 'c' END AS bond FROM hp GROUP BY 1, 2, 3 HAVING count(*) >= 2),
pr AS (SELECT a.record_id, a.pos AS i, b.pos AS j, {G.overlap('a', 'b')} AS overlap, {G.angle('a', 'b')} AS turn, a.etype = 'E' AND b.etype = 'E' AND a.sheet = b.sheet AS same FROM ax a JOIN ax b ON a.record_id = b.record_id AND a.pos < b.pos)
SELECT CAST(pr.record_id AS VARCHAR) AS record_id, pr.i, pr.j, coalesce(bond, CASE WHEN overlap > 2.5 AND gap <= 11 AND NOT coalesce(same, false) THEN CASE WHEN turn > 95 THEN 'v' WHEN turn < 85 THEN 'u' ELSE 'N' END ELSE '-' END) AS code
FROM pr JOIN gp ON gp.record_id = pr.record_id AND gp.i = pr.i AND gp.j = pr.j LEFT JOIN bd ON bd.record_id = pr.record_id AND bd.i = pr.i AND bd.j = pr.j"""


@query("built_records", _built_sql())
def built_records(spark, sf_dir):
    """Codes of records built from card text: labels, order, axes, residue distances, bonds and sheets."""
    return X.contacts_of(B.build_records(_cards(spark, sf_dir)))


@query("mean_confidence", "SELECT CAST(vec_id AS VARCHAR) AS file, round(avg(CAST(round(50 + i + vec_id % 7 / 10.0, 2) AS DOUBLE)), 4) AS confidence FROM embeddings, range(21) r(i) GROUP BY vec_id")
def mean_confidence(spark, sf_dir):
    """Mean of the last data column over a structure's alpha carbons."""
    lines = X.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.posexplode(F.expr("transform(sequence(0, 20), i -> format_string('ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f', i, i, 0e0, 0e0, 0e0, 1e0, 50 + i + vec_id % 7 / 10e0))")).alias("at", "line"))
    return ssd.mean_confidence(lines).select("file", F.round("confidence", 4).alias("confidence"))


@query("cell_spread")
def cell_spread_query(spark, sf_dir):
    """Median distance after superposition among the first motifs of each label; a motif is ten points."""
    points = X.read(spark, sf_dir, "embeddings").selectExpr("label AS cell", "vec_id AS motif", "transform(slice(embedding, 1, 30), x -> cast(x as double) * 40e0) AS points")
    return cell_spread(points)
