"""Text formats: round trips, validation, matrix rows, streaming sweep, pair signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.operators.signatures import connected_signatures, connected_subsets, two_sheet_signatures
from foldlattice.operators.projection import by_chain
from foldlattice.operators.search import search
from foldlattice.queries.motifs import GEOM, MOTIFS, TOPO
from foldlattice.plans.motif import motif_sql
from foldlattice.sources import hit_text, metamatrix
from foldlattice.streaming.sweep import sweep_chunks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _labelled(records):
    """Geometric records with residue labels, as the text format wants them."""
    return records.withColumn("elements", F.expr("transform(elements, (e, i) -> named_struct('etype', e.etype, 'chain', e.chain, 'begin_label', cast(10 * i + 1 as string), 'end_label', cast(10 * i + e.length as string), 'length', e.length, 'fx', e.fx, 'fy', e.fy, 'fz', e.fz, 'lx', e.lx, 'ly', e.ly, 'lz', e.lz))"))


def _lines(spark, sf_dir):
    """Eight files' worth of lines: a file's records follow one another."""
    lines = metamatrix.render(_labelled(X.geometric(spark, sf_dir)))
    return lines.select((F.col("record_id") % 8).alias("file"), (F.col("record_id") * 100 + F.col("place")).alias("at"), "line")


@query("metamatrix_roundtrip", GEOM + "SELECT CAST(e.record_id AS VARCHAR) AS record_id, e.pos, e.etype, e.chain, e.length, coalesce(string_agg(c.code, '' ORDER BY c.j), '') AS codes FROM el1 e LEFT JOIN ct1 c ON c.record_id = e.record_id AND c.i = e.pos GROUP BY ALL")
def metamatrix_roundtrip(spark, sf_dir):
    back = metamatrix.parse(_lines(spark, sf_dir))
    return back.select("record_id", F.posexplode(F.arrays_zip("elements", "rows")).alias("p", "x")).select("record_id", (F.col("p") + 1).alias("pos"), "x.elements.etype", "x.elements.chain", "x.elements.length", F.expr("substring(x.rows, 2)").alias("codes"))


@query("metamatrix_validate", "SELECT * FROM (SELECT 'records' AS problem, count(*) - count(*) FILTER (WHERE vec_id % 50 = 7) - count(*) FILTER (WHERE vec_id % 50 = 8) AS n FROM embeddings UNION ALL SELECT 'header_no_matrix', count(*) FROM embeddings WHERE vec_id % 50 = 7 UNION ALL SELECT 'orphan_block', 0 UNION ALL SELECT 'extra_matrix', 0 UNION ALL SELECT 'field_overflow', count(*) FROM embeddings WHERE vec_id % 50 = 8 UNION ALL SELECT 'stray', count(*) FROM embeddings WHERE vec_id % 50 = 9)")
def metamatrix_validate(spark, sf_dir):
    """What is wrong with damaged text."""
    return metamatrix.validate(_damaged(spark, sf_dir))


@query("metamatrix_clean", "SELECT CAST(vec_id AS VARCHAR) AS record_id, CAST(10 AS INTEGER) AS n FROM embeddings WHERE vec_id % 50 NOT IN (7, 8)")
def metamatrix_clean(spark, sf_dir):
    """Records of damaged text that are left when it is cleaned."""
    return metamatrix.parse(metamatrix.clean(_damaged(spark, sf_dir))).select("record_id", "n")


def _damaged(spark, sf_dir):
    """Records without a matrix, with an overlong header, with a stray line."""
    own = F.floor(F.col("at") / 100)
    lines = _lines(spark, sf_dir).where(~((F.pmod(own, F.lit(50)) == 7) & F.col("line").startswith("*")))
    lines = lines.withColumn("line", F.when((F.pmod(own, F.lit(50)) == 8) & F.col("line").contains(".ssd"), F.concat("line", F.lit("9"))).otherwise(F.col("line")))
    stray = lines.where((F.pmod(own, F.lit(50)) == 9) & F.col("line").startswith("*")).select("file", F.col("at") + 1, F.lit("?? stray").alias("line"))
    return lines.unionByName(stray.toDF("file", "at", "line"))


@query("matrix_explode", TOPO + "SELECT e.record_id, e.pos AS row, '*' || coalesce(string_agg(c.code, '' ORDER BY c.j), '') AS codes FROM el2 e LEFT JOIN ct2 c ON c.record_id = e.record_id AND c.i = e.pos GROUP BY ALL")
def matrix_explode(spark, sf_dir):
    return X.topological(spark, sf_dir).select("record_id", F.posexplode("rows").alias("r", "codes")).select("record_id", (F.col("r") + 1).alias("row"), "codes")


@query("per_chain_reindex", TOPO + "SELECT record_id, pos, chain, CAST(row_number() OVER (PARTITION BY record_id, chain ORDER BY pos) AS INTEGER) AS chain_pos FROM el2")
def per_chain_reindex(spark, sf_dir):
    own = X.topological(spark, sf_dir).select("record_id", "elements", F.posexplode("elements").alias("p", "e"))
    return own.select("record_id", (F.col("p") + 1).alias("pos"), F.col("e.chain").alias("chain"), F.expr("size(filter(slice(elements, 1, p + 1), x -> x.chain = e.chain))").alias("chain_pos"))


@query("chain_projection", GEOM + """, e AS (SELECT record_id, chain, pos, row_number() OVER (PARTITION BY record_id, chain ORDER BY pos) AS k FROM el1),
c AS (SELECT a.record_id, a.chain, string_agg(ct1.code, '' ORDER BY a.k, b.k) AS codes FROM e a JOIN e b ON a.record_id = b.record_id AND a.chain = b.chain AND a.pos < b.pos JOIN ct1 ON ct1.record_id = a.record_id AND ct1.i = a.pos AND ct1.j = b.pos GROUP BY ALL),
s AS (SELECT record_id, chain, sheet, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS own FROM e JOIN sh1 USING (record_id, pos) GROUP BY ALL), t AS (SELECT record_id, chain, string_agg(own, '|' ORDER BY sheet) AS sheets FROM s GROUP BY ALL)
SELECT record_id, chain, CAST(count(*) AS INTEGER) AS n, coalesce(any_value(codes), '') AS codes, coalesce(any_value(sheets), '') AS sheets FROM e LEFT JOIN c USING (record_id, chain) LEFT JOIN t USING (record_id, chain) GROUP BY record_id, chain""")
def chain_projection(spark, sf_dir):
    """Each chain's own matrix and sheets, renumbered."""
    own = by_chain(X.geometric(spark, sf_dir))
    return own.select("record_id", "chain", "n", F.expr("replace(array_join(rows, ''), '*', '')").alias("codes"), F.expr("array_join(transform(sheets, s -> array_join(s, ',')), '|')").alias("sheets"))


def _segments(spark, sf_dir):
    records = X.topological(spark, sf_dir)
    found = search(records, MOTIFS["t3"]).join(records.select("record_id", "elements"), "record_id")
    segment = "transform(split(positions, ','), p -> named_struct('etype', element_at(elements, cast(p as int)).etype, 'pos', cast(p as int), 'begin', concat(p, 'A'), 'end', cast(element_at(elements, cast(p as int)).length as string), 'chain', element_at(elements, cast(p as int)).chain, 'length', element_at(elements, cast(p as int)).length))"
    return found.select("query_id", "record_id", "motif_idx", F.expr(segment).alias("segments"))


@query("hit_segments_parse", TOPO + f"""SELECT h.query_id, h.record_id, h.motif_idx, e.etype, e.pos, CAST(e.pos AS VARCHAR) || 'A' AS "begin", CAST(e.length AS VARCHAR) AS "end", e.chain, e.length
FROM (SELECT * FROM ({motif_sql(MOTIFS["t3"], "el2", "ct2")})) h JOIN el2 e ON e.record_id = h.record_id AND list_contains(string_split(h.positions, ','), CAST(e.pos AS VARCHAR))""")
def hit_segments_parse(spark, sf_dir):
    """Hits written as text and read back: one row a segment."""
    back = hit_text.parse(hit_text.render(_segments(spark, sf_dir)))
    return back.select("query_id", "record_id", "motif_idx", F.explode("segments").alias("s")).select("query_id", "record_id", "motif_idx", "s.*")


@query("stream_sweep", TOPO + motif_sql(MOTIFS["t3"], "el2", "ct2"))
def stream_sweep(spark, sf_dir):
    """The t3 motif over record chunks that arrive as a stream; equals the batch search."""
    return sweep_chunks(X.topological(spark, sf_dir), MOTIFS["t3"], chunks=4)


@query("signature_vocabulary", GEOM + """, adj AS (SELECT record_id, i, j, code <> '-' AS a FROM ct1), s AS (
SELECT e1.record_id, concat(CASE WHEN a12.a THEN 1 ELSE 0 END, CASE WHEN a13.a THEN 1 ELSE 0 END, CASE WHEN a23.a THEN 1 ELSE 0 END) AS sig FROM el1 e1 JOIN el1 e2 ON e2.record_id = e1.record_id AND e2.pos > e1.pos JOIN el1 e3 ON e3.record_id = e1.record_id AND e3.pos > e2.pos
JOIN adj a12 ON a12.record_id = e1.record_id AND a12.i = e1.pos AND a12.j = e2.pos JOIN adj a13 ON a13.record_id = e1.record_id AND a13.i = e1.pos AND a13.j = e3.pos JOIN adj a23 ON a23.record_id = e1.record_id AND a23.i = e2.pos AND a23.j = e3.pos
WHERE CAST(a12.a AS INT) + CAST(a13.a AS INT) + CAST(a23.a AS INT) >= 2) SELECT sig, count(DISTINCT record_id) AS records, count(*) AS subsets FROM s GROUP BY sig""")
def signature_vocabulary(spark, sf_dir):
    return connected_signatures(X.geometric(spark, sf_dir)).groupBy("sig").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("subsets"))


def _five_sql() -> str:
    pairs = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
    joins = " ".join(f"JOIN fit e{k} ON e{k}.record_id = e1.record_id AND e{k}.pos > e{k - 1}.pos" for k in range(2, 6))
    bits = " ".join(f"JOIN adj a{a}{b} ON a{a}{b}.record_id = e1.record_id AND a{a}{b}.i = e{a}.pos AND a{a}{b}.j = e{b}.pos" for a, b in pairs)
    near = ", ".join(" + ".join(f"{1 << (o - 1)} * c{min(k, o)}{max(k, o)}" for o in range(1, 6) if o != k) + f" AS m{k}" for k in range(1, 6))
    steps = ""
    for n in range(4):
        steps += f", r{n + 1} AS (SELECT * EXCLUDE (reach), reach | " + " | ".join(f"CASE WHEN reach & {1 << (k - 1)} <> 0 THEN m{k} ELSE 0 END" for k in range(1, 6)) + f" AS reach FROM r{n})"
    part = " || ".join(f"CAST(len(list_distinct(list_slice(s, 1, list_position(s, s[{k}]) - 1))) AS VARCHAR)" for k in range(1, 6))
    return f""", adj AS (SELECT record_id, i, j, CASE WHEN code <> '-' THEN 1 ELSE 0 END AS a FROM ct1),
fit AS (SELECT e.record_id, e.pos, coalesce(s.sheet, 0) AS sheet FROM el1 e LEFT JOIN (SELECT record_id, pos, sheet FROM sh1) s ON s.record_id = e.record_id AND s.pos = e.pos WHERE (etype = 'H' AND length >= 8) OR (etype = 'E' AND length >= 5)),
five AS (SELECT e1.record_id, concat_ws(',', e1.pos, e2.pos, e3.pos, e4.pos, e5.pos) AS positions, [e1.sheet, e2.sheet, e3.sheet, e4.sheet, e5.sheet] AS s, {', '.join(f'a{a}{b}.a AS c{a}{b}' for a, b in pairs)} FROM fit e1 {joins} {bits}),
r0 AS (SELECT *, {near}, 1 AS reach FROM five WHERE len(list_distinct(list_filter(s, lambda x: x <> 0))) = 2){steps},
sig AS (SELECT record_id, positions, {part} AS partition, concat({', '.join(f'c{a}{b}' for a, b in pairs)}) AS contacts FROM r4 WHERE reach = 31)"""


@query("two_sheet_signatures", GEOM + _five_sql() + " SELECT partition, contacts, count(DISTINCT record_id) AS records, count(*) AS subsets FROM sig GROUP BY ALL")
def two_sheet_signature_query(spark, sf_dir):
    """Vocabulary of connected five-element subsets over two sheets."""
    return two_sheet_signatures(X.geometric(spark, sf_dir)).groupBy("partition", "contacts").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("subsets"))


@query("dark_to_vocabulary", GEOM + _five_sql() + """, t AS (SELECT DISTINCT partition, contacts, record_id FROM sig WHERE record_id % 2 = 1), v AS (SELECT DISTINCT partition, contacts FROM sig WHERE record_id % 2 = 0)
SELECT record_id, count(*) AS dark FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.partition = t.partition AND v.contacts = t.contacts) GROUP BY record_id""")
def dark_to_vocabulary(spark, sf_dir):
    """Signatures of one half of the records that the other half's vocabulary lacks, by record."""
    own = two_sheet_signatures(X.geometric(spark, sf_dir)).select("partition", "contacts", "record_id").distinct()
    vocabulary = own.where("record_id % 2 = 0").select("partition", "contacts").distinct()
    return own.where("record_id % 2 = 1").join(vocabulary, ["partition", "contacts"], "left_anti").groupBy("record_id").agg(F.count("*").alias("dark"))


def _bonded_sql(k: int) -> str:
    """Growing sets of strands from any of their bonds, repeats dropped."""
    grown = "".join(f", s{n} AS (SELECT DISTINCT s.record_id, list_sort(list_append(s.places, e.b)) AS places FROM s{n - 1} s JOIN edge e ON e.record_id = s.record_id AND list_contains(s.places, e.a) AND NOT list_contains(s.places, e.b))" for n in range(3, k + 1))
    return f"""WITH {X.LONG_SQL}, edge AS (SELECT record_id, i AS a, j AS b FROM ct3 WHERE code = 't' UNION ALL SELECT record_id, j, i FROM ct3 WHERE code = 't'),
s2 AS (SELECT DISTINCT record_id, list_sort([a, b]) AS places FROM edge){grown}
SELECT record_id, count(*) AS subsets, CAST(min(places[1]) AS INTEGER) AS first, CAST(max(places[{k}]) AS INTEGER) AS last FROM s{k} GROUP BY record_id"""


@query("long_record_subsets", _bonded_sql(5))
def long_record_subsets(spark, sf_dir):
    """Connected sets of five strands by t contacts in customers' lines, where all subsets of five are millions a record."""
    found = connected_subsets(X.long_records(spark, sf_dir), 5, "element_at(elements, p).etype = 'E'", "t")
    return found.groupBy("record_id").agg(F.count("*").alias("subsets"), F.min(F.col("places")[0]).alias("first"), F.max(F.col("places")[4]).alias("last"))


@query("fitting_histogram", GEOM + ", f AS (SELECT record_id, count(*) FILTER (WHERE (etype = 'H' AND length >= 8) OR (etype = 'E' AND length >= 5)) AS fit FROM el1 GROUP BY 1) SELECT CAST(fit AS INTEGER) AS fit, count(*) AS records FROM f GROUP BY 1")
def fitting_histogram(spark, sf_dir):
    """Records by how many elements are long enough."""
    fit = F.expr("size(filter(elements, e -> (e.etype = 'H' AND e.length >= 8) OR (e.etype = 'E' AND e.length >= 5)))").alias("fit")
    return X.geometric(spark, sf_dir).groupBy(fit).agg(F.count("*").alias("records"))


@query("eligibility_classes", GEOM + _five_sql().replace("WHERE len(list_distinct(list_filter(s, lambda x: x <> 0))) = 2", "") + """, n AS (SELECT record_id, count(*) AS n, count(*) FILTER (WHERE (etype = 'H' AND length >= 8) OR (etype = 'E' AND length >= 5)) AS fit FROM el1 GROUP BY 1)
SELECT CASE WHEN n < 5 THEN 'A' WHEN fit < 5 THEN 'B' WHEN NOT EXISTS (SELECT 1 FROM sig WHERE sig.record_id = n.record_id) THEN 'C' ELSE 'D' END AS class, count(*) AS records FROM n GROUP BY 1""")
def eligibility_classes(spark, sf_dir):
    """Records with too few elements (A), too few long ones (B), no five of these connected (C), and the rest (D)."""
    records = X.geometric(spark, sf_dir)
    fit = F.expr("size(filter(elements, e -> (e.etype = 'H' AND e.length >= 8) OR (e.etype = 'E' AND e.length >= 5)))").alias("fit")
    joined = two_sheet_signatures(records, any_sheets=True).select("record_id").distinct().withColumn("five", F.lit(True))
    label = F.when(F.col("n") < 5, "A").when(F.col("fit") < 5, "B").when(F.col("five").isNull(), "C").otherwise("D").alias("class")
    return records.select("record_id", "n", fit).join(joined, "record_id", "left").groupBy(label).agg(F.count("*").alias("records"))
