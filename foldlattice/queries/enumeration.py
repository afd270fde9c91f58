"""Enumerated topologies and the motif corpus they give."""

from __future__ import annotations

from dataclasses import replace
from itertools import islice, permutations, product

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.functions import geometry as G
from foldlattice.operators import corpus as C
from foldlattice.operators.lattice import GRID_POINTS, canonical, chiral_triples, compact, declared_skeletons, handedness_classes, joined, skeletons, with_grid
from foldlattice.operators.search import search, sense_at, senses_sql
from foldlattice.operators.signatures import connected_signatures
from foldlattice.operators.sweep import sweep
from foldlattice.plans.extension import contacts_only, extended
from foldlattice.plans.motif import motif_sql, parse_motif
from foldlattice.queries.motifs import GEOM, MOTIFS, TOPO

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _cells(spark, sf_dir, key: str, parts):
    """``key, n, lit, hits``: enumerated items as cells of a grid over orders, which fall on them by their keys in turn.

    Items are numbered in the order of their columns; ``lit`` have an order, ``hits`` counts orders on them.
    """
    keys = X.read(spark, sf_dir, "orders").select("o_orderkey")
    out = None
    for name, items in parts:
        cells = items.select((F.row_number().over(W.orderBy(*items.columns)) - 1).alias("cell")).withColumn("n", F.count("*").over(W.partitionBy()))  # an enumeration
        size = cells.agg(F.max("n").alias("size"))
        hits = keys.join(F.broadcast(size)).groupBy(F.pmod("o_orderkey", "size").alias("cell")).agg(F.count("*").alias("hits"))
        own = cells.join(hits, "cell", "left").agg(F.lit(name).alias(key), F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("lit"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        out = own if out is None else out.unionByName(own)
    return out


def _golden(*pairs: tuple, key: str = "dim", kind: str = "INTEGER") -> str:
    """Published counts, and the orders that fall on as many cells."""
    return f"SELECT CAST({key} AS {kind}) AS {key}, CAST(n AS BIGINT) AS n, count(DISTINCT o_orderkey % n) AS lit, count(*) AS hits FROM (VALUES {', '.join(map(str, pairs))}) v({key}, n), orders GROUP BY {key}, n"


@query("skeleton_counts", _golden((1, 1), (2, 1), (3, 5), (4, 42), (5, 198)))
def skeleton_counts(spark, sf_dir):
    return _cells(spark, sf_dir, "dim", [(n, skeletons(spark, n).select("nth")) for n in range(1, 6)])


@query("typed_query_counts", _golden((3, 40), (4, 672), (5, 6336)))
def typed_query_counts(spark, sf_dir):
    return _cells(spark, sf_dir, "dim", [(n, C.corpus(spark, n).select("nth", "ty")) for n in (3, 4, 5)])


@query("fitting_query_counts", _golden((5, 744)))
def fitting_query_counts(spark, sf_dir):
    """Five-point motifs whose straight runs are of one type."""
    return _cells(spark, sf_dir, "dim", [(5, C.fitting_corpus(spark, 5).select("nth", "ty"))])


@query("minimal_query_counts", _golden((5, 708)))
def minimal_query_counts(spark, sf_dir):
    """Five-point motifs on known grids with the fewest contacts and senses."""
    return _cells(spark, sf_dir, "dim", [(5, C.minimal_corpus(spark).select("query_id"))])


@query("rcc_counts", _golden((3, 3), (4, 23), (5, 164)))
def rcc_counts(spark, sf_dir):
    """Skeletons left of each handedness signature."""
    return _cells(spark, sf_dir, "dim", [(n, handedness_classes(skeletons(spark, n)).select("nth")) for n in (3, 4, 5)])


@query("declared_counts", _golden((3, 19), (4, 358), (5, 4842)))
def declared_counts(spark, sf_dir):
    return _cells(spark, sf_dir, "dim", [(n, declared_skeletons(spark, n)) for n in (3, 4, 5)])


@query("grid_counts", _golden(("d", 12), ("e", 40), ("f", 60), ("gh", 28), key="grid", kind="VARCHAR"))
def grid_counts(spark, sf_dir):
    """Five-point skeletons by the grid that they are congruent to."""
    held = with_grid(skeletons(spark, 5)).select("nth", "grid")
    return _cells(spark, sf_dir, "grid", [(g, held.where(F.col("grid") == g).select("nth")) for g in GRID_POINTS])


@query("chiral_triples", GEOM + f"""SELECT s.shape, s.chirality, count(t.side) AS triples FROM
(SELECT shape, chirality FROM (VALUES ('101'), ('011'), ('110'), ('111')) s(shape), (VALUES (''), ('L'), ('R')) c(chirality) WHERE NOT (shape = '111' AND chirality = '')) s
LEFT JOIN (SELECT concat(CAST(x.code <> '-' AS INT), CAST(y.code <> '-' AS INT), CAST(z.code <> '-' AS INT)) AS shape, {G.chirality('a', 'b', 'c')} AS side
  FROM el1 a JOIN el1 b ON a.record_id = b.record_id AND a.pos < b.pos JOIN el1 c ON a.record_id = c.record_id AND b.pos < c.pos
  JOIN ct1 x ON x.record_id = a.record_id AND x.i = a.pos AND x.j = b.pos JOIN ct1 y ON y.record_id = a.record_id AND y.i = a.pos AND y.j = c.pos JOIN ct1 z ON z.record_id = a.record_id AND z.i = b.pos AND z.j = c.pos) t
ON t.shape = s.shape AND t.side = s.chirality GROUP BY s.shape, s.chirality""")
def chiral_triple_query(spark, sf_dir):
    """Shapes and senses that three-point skeletons can have, with the records' element triples of each."""
    records = X.geometric(spark, sf_dir).withColumn("senses", F.expr(senses_sql((0, 1, 2))))
    held = connected_signatures(records, keep=("senses",)).select(F.col("sig").alias("shape"), F.expr(f"replace({sense_at('senses', 'i', 'j', 'm')}, '-', '')").alias("chirality"))
    return chiral_triples(skeletons(spark, 3)).join(held.groupBy("shape", "chirality").agg(F.count("*").alias("triples")), ["shape", "chirality"], "left").select("shape", "chirality", F.coalesce("triples", F.lit(0)).alias("triples"))


_STEP = "((b.q - a.q, b.r - a.r) IN ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)))"


@query("query_corpus_k3", f"""WITH sk AS (SELECT * FROM (VALUES ('0,0;-2,0;-1,0'), ('0,0;-1,0;-2,0'), ('0,0;-1,0;1,0'), ('0,0;-1,0;-1,1'), ('0,0;-1,0;0,-1')) v(points)),
pt AS (SELECT points, k, CAST(split_part(split_part(points, ';', k), ',', 1) AS INTEGER) AS q, CAST(split_part(split_part(points, ';', k), ',', 2) AS INTEGER) AS r FROM sk, (VALUES (1), (2), (3)) n(k)),
nb AS (SELECT a.points, a.k AS i, b.k AS j, {_STEP} AS near FROM pt a JOIN pt b ON a.points = b.points AND a.k < b.k),
ty AS (SELECT CAST(ty AS INTEGER) AS ty, translate(lpad(bin(ty), 3, '0'), '01', 'HE') AS types FROM range(8) t(ty)),
od AS (SELECT CAST(floor(o_orderkey / 20) AS BIGINT) % 8 AS ty, count(*) AS hits FROM orders GROUP BY 1),
c AS (SELECT nb.points, ty, types, i, j, substr(types, CAST(i AS INTEGER), 1) AS a, substr(types, CAST(j AS INTEGER), 1) AS b, near, (SELECT bool_and(o.near) FROM nb o WHERE o.points = nb.points AND (o.i, o.j) <> (nb.i, nb.j)) AND types = 'EEE' AS joined FROM nb, ty)
SELECT points, ty, types, (SELECT hits FROM od WHERE od.ty = c.ty) AS hits, string_agg(CASE WHEN NOT near THEN CASE WHEN joined THEN '-' ELSE 'X' END WHEN a = 'E' AND b = 'E' THEN CASE WHEN (j - i) % 2 = 0 THEN 'c' ELSE 't' END WHEN a = b THEN CASE WHEN (j - i) % 2 = 0 THEN 'u' ELSE 'v' END ELSE CASE WHEN (j - i) % 2 = 0 THEN 'C' ELSE 'T' END END, '' ORDER BY i, j) AS codes FROM c GROUP BY ALL""")
def query_corpus_k3(spark, sf_dir):
    """Codes of the three-point corpus, from its texts (rows of the matrix without their diagonal), with the orders of each typing's cell."""
    rows = F.expr("transform(slice(split(text, '\n'), 3, 3), x -> substring(replace(x, ' ', ''), 2))")
    hits = X.read(spark, sf_dir, "orders").groupBy((F.floor(F.col("o_orderkey") / 20) % 8).cast("int").alias("ty")).agg(F.count("*").alias("hits"))
    return C.corpus(spark, 3).join(skeletons(spark, 3), "nth").join(hits, "ty", "left").select("points", "ty", "types", "hits", F.array_join(rows, "").alias("codes"))


def _larger():
    """Contact-only motifs that add one element to a straight sheet of four strands and to one with a helix at its end."""
    row = tuple((q, 0) for q in range(4))
    return C.one_larger(row, "EEEE", "s5t-e") + C.one_larger(row, "EEEH", "s5t-h")


@query("targeted_six", GEOM + " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(m, 'el1', 'ct1', 'sh1', chirality=G.chirality)})" for m in _larger()))
def targeted_six(spark, sf_dir):
    """Hits in all records of motifs that add one element to a typed skeleton."""
    return sweep(X.geometric(spark, sf_dir), _larger())


def _corpus_of(n: int):
    """The corpus of n elements without a session: all placements of smaller skeletons at larger ones, as ``skeletons`` numbers them."""

    def frames(k: int) -> list:
        found: dict = {}
        for q in range(1, k // 2 + 1):
            for first, second in product(frames(k - q), frames(q)):
                for c in joined(first, second):
                    if compact(c):
                        found.setdefault(canonical(c), c)
        return list(found.values()) if k > 2 else [((0, 0), (1, 0))[:k]]

    typed = ["".join(t) for t in product("HE", repeat=n)]
    return [C.typed_motif(f"s{n}-{nth:04d}-{ty:04d}", frame, types) for nth, frame in enumerate(frames(n)) for ty, types in enumerate(typed)]


_ASKED = ", ".join(str((m.motif_id, C.crowded(m), C.bonds_asked(m))) for m in _corpus_of(5))


@query("crowded_motifs", TOPO + f""", m AS (SELECT * FROM (VALUES {_ASKED}) v(query_id, crowded, asked)),
d AS (SELECT record_id, p, count(*) AS n FROM (SELECT record_id, i AS p FROM ct2 WHERE code IN ('c', 't') UNION ALL SELECT record_id, j FROM ct2 WHERE code IN ('c', 't')) GROUP BY 1, 2),
h AS (SELECT record_id, list(n ORDER BY n DESC) AS held FROM d GROUP BY 1)
SELECT query_id, crowded, CASE WHEN len(asked) = 0 THEN (SELECT count(*) FROM (SELECT DISTINCT record_id FROM el2)) ELSE (SELECT count(*) FROM h WHERE len(held) >= len(asked) AND len([k for k in range(len(asked)) if held[k + 1] < asked[k + 1]]) = 0) END AS records FROM m""")
def crowded_motifs(spark, sf_dir):
    """All motifs of five elements, whether they ask a strand for three or more bonded neighbours, and the records with strands enough for them."""
    return C.room_for(X.topological(spark, sf_dir), C.corpus_motifs(spark, 5))


def _orders_of_grids():
    """Motifs over every fourth compact order of each grid's points, of strands alone and with a helix."""
    out = []
    for grid, points in GRID_POINTS.items():
        for k, p in enumerate(islice((p for p in permutations(points) if compact(p)), 0, None, 4)):
            out += [C.typed_motif(f"{grid}{k}-{types}", p, types) for types in ("EEEEE", "EEHEE")]
    return out


def _marked():
    """The crowded ones, without handedness, which orders' records have no points for."""
    return [replace(m, handedness=()) for m in _orders_of_grids() if C.crowded(m)]


@query("crowded_witnesses", TOPO + ", none AS (SELECT CAST(0 AS BIGINT) AS record_id, 0 AS sheet, 0 AS pos WHERE false), found AS (" + " UNION ALL ".join(f"SELECT query_id, record_id FROM ({motif_sql(m, 'el2', 'ct2', 'none')})" for m in _marked()) + f""")
SELECT query_id, count(record_id) AS hits, count(DISTINCT record_id) AS hit_records FROM (SELECT unnest({[m.motif_id for m in _marked()]}) AS query_id) LEFT JOIN found USING (query_id) GROUP BY query_id""")
def crowded_witnesses(spark, sf_dir):
    """Marked motifs with their hits in all records: each hit contradicts the mark."""
    motifs = _marked()
    records = X.topological(spark, sf_dir)
    able = C.room_for(records, motifs).select("query_id")
    hits = sweep(records, motifs).groupBy("query_id").agg(F.count("*").alias("hits"), F.countDistinct("record_id").alias("hit_records"))
    return able.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("hit_records", F.lit(0)).alias("hit_records"))


def _constrained():
    """Three- to five-element motifs over geometric records, between them with every kind of constraint."""
    texts = {
        "c3_right": "1 2 3\nE H E\n* x X\n* x\n*\nhandedness 1 2 3 R", "c3_left": "1 2 3\nX H E\n* x X\n* x\n*\nhandedness 1 2 3 L\nchainAll",
        "c3_same": "1 2 3\nE E E\n* x X\n* x\n*\nsheetS 1 2 3", "c3_diff": "1 2 3\nE H E\n* x X\n* x\n*\nsheetD 1 3\nlength 2 H 12 1000",
        "c3_chains": "1 2 3\nX X E\n* T X\n* x\n*\nchainD 1 3", "c3_one": "1 2 3\nE X H\n* X C\n* x\n*\nchainS 1 3\nchainAll",
        "c4": "1 2 3 4\nE E E H\n* X X X\n* t X\n* T\n*\nsheetS 2 3\nsheetD 1 2 3\nhandedness 1 2 3 R\nhandedness 2 3 4 L\nlength 1 E 5 30\nlength 4 H 8 1000\nchainAll",
        "c5": "1 2 3 4 5\nE X E E X\n* X X X X\n* X x X\n* t X\n* x\n*\nsheetS 3 4\nsheetD 1 4\nhandedness 1 3 4 R\nchainAll",
    }
    return [parse_motif(name, text) for name, text in texts.items()]


def _union_sql(own) -> str:
    return " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(m, 'el1', 'ct1', 'sh1', chirality=G.chirality)})" for m in own)


@query("sweep_constraints", GEOM + _union_sql(_constrained()))
def sweep_constraints(spark, sf_dir):
    """Motifs of several sizes with sheets, chains, lengths and handedness in one sweep."""
    return sweep(X.geometric(spark, sf_dir), _constrained())


@query("corpus_sweep_k3", GEOM + _union_sql(_corpus_of(3)))
def corpus_sweep_k3(spark, sf_dir):
    """Hits of the whole three-element corpus, with its sheet, length and handedness lines."""
    return sweep(X.geometric(spark, sf_dir), C.corpus_motifs(spark, 3))


@query("corpus_sweep")
def corpus_sweep(spark, sf_dir):
    """Records and hits of each motif of the five-element corpus (6,336 motifs) that has any."""
    found = sweep(X.geometric(spark, sf_dir), C.corpus_motifs(spark, 5))
    return found.groupBy("query_id").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("hits"))


def _long_motifs():
    """Motifs for records of tens of elements; the third is a part of the fourth."""
    texts = {
        "l5_ladder": "1 2 3 4 5\nE E E E H\n* t X X X\n* c X X\n* t X\n* v\n*\nchainAll",
        "l5_helices": "1 2 3 4 5\nH H H H H\n* u X X X\n* v X X\n* u X\n* v\n*",
        "l3_pair": "1 2 3\nE E H\n* t X\n* u\n*\nlength 3 H 30 50\nchainAll",
        "l4_pair": "1 2 3 4\nE E H E\n* t X c\n* u X\n* X\n*\nlength 3 H 30 50\nchainAll",
        "l6": "1 2 3 4 5 6\nE H E H E L\n* X t X X X\n* N X X X\n* X c X\n* N X\n* v\n*\nchainD 1 6",
    }
    return [parse_motif(name, text) for name, text in texts.items()]


@query("long_record_sweep", f"WITH {X.LONG_SQL} " + " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(m, 'el3', 'ct3')})" for m in _long_motifs()))
def long_record_sweep(spark, sf_dir):
    """Motifs of three to six elements over customers' lines, records cut and dealt out by their work."""
    return sweep(X.long_records(spark, sf_dir), _long_motifs(), tasks=spark.sparkContext.defaultParallelism)


def _corpus_sample():
    """Typed motifs over the first compact orders of each grid's five points, with all lines that the corpus writes."""
    out = []
    for grid, points in GRID_POINTS.items():
        orders = islice((p for p in permutations(points) if compact(p)), 2)
        out += [C.typed_motif(f"{grid}-{types}", p, types) for p, types in zip(orders, ("EEHEE", "HHHEH"))]
    return out


@query("corpus_sweep_sample", GEOM + _union_sql(_corpus_sample()))
def corpus_sweep_sample(spark, sf_dir):
    """Hits in all records of motifs as the five-element corpus has them, taken from every grid."""
    return sweep(X.geometric(spark, sf_dir), _corpus_sample())


_EXTENDED = extended(MOTIFS["t2"])


@query("motif_extensions", TOPO + " UNION ALL ".join(f"SELECT query_id, record_id, positions FROM ({motif_sql(m, 'el2', 'ct2')})" for m in _EXTENDED))
def motif_extensions(spark, sf_dir):
    """All one-element extensions of a two-strand motif in one sweep."""
    return sweep(X.topological(spark, sf_dir), _EXTENDED)


@query("motif_contacts_only", TOPO + motif_sql(contacts_only(MOTIFS["t3"]), "el2", "ct2"))
def motif_contacts_only(spark, sf_dir):
    return search(X.topological(spark, sf_dir), contacts_only(MOTIFS["t3"]))
