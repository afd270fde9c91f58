"""From residues to elements: range joins, axes, bonds between strands, sheets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from foldlattice.functions import geometry as G
from foldlattice.sources import ssd

#: Least sizes of kept elements (fixed values).
LEAST_HELIX, LEAST_STRAND, LEAST_LINKER = 5, 2, 3


def keep_elements(elements: DataFrame) -> DataFrame:
    """Drops helices under 5 residues, strands under 2 and linkers under 3."""
    return elements.where(f"(etype = 'H' AND length >= {LEAST_HELIX}) OR (etype = 'E' AND length >= {LEAST_STRAND}) OR (etype = 'L' AND length >= {LEAST_LINKER})")


def residues_of(elements: DataFrame, residues: DataFrame) -> DataFrame:
    """Residues with the elements whose range holds them: equal record and chain, idx between both ends."""
    e, r = elements.alias("e"), residues.alias("r")
    on = (F.col("e.record_id") == F.col("r.record_id")) & (F.col("e.chain") == F.col("r.chain")) & F.col("r.idx").between(F.col("e.begin_idx"), F.col("e.end_idx"))
    return e.join(r, on).select("e.record_id", "e.pos", "e.etype", "r.idx", "r.x", "r.y", "r.z")


def _points(held: DataFrame) -> DataFrame:
    """One row an element with its residues in order; an element's residues are few."""
    return held.groupBy("record_id", "pos", "etype").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("ca"))


def strand_axes(held: DataFrame) -> DataFrame:
    """``record_id, pos, fx..lz``: strands' and linkers' axes by built-in expressions.

    Over three residues: the line through two bond midpoints a third from either end, and the first and
    last residue projected on it.  Three: the line through both bond midpoints.  Two: the residues.
    """
    own = _points(held).withColumn("n", F.size("ca")).where("n >= 2").withColumn("k", F.expr("cast(CASE WHEN n > 3 THEN floor(n / 3) ELSE 1 END as int)"))

    def mid(a: str, b: str, c: str) -> str:
        return f"((element_at(ca, {a}).{c} + element_at(ca, {b}).{c}) / 2e0)"

    # element_at counts from 1
    near = {c: f"CASE WHEN n = 2 THEN element_at(ca, 1).{c} ELSE {mid('k', 'k + 1', c)} END" for c in "xyz"}
    far = {c: f"CASE WHEN n = 2 THEN element_at(ca, 2).{c} ELSE {mid('n - k', 'n - k + 1', c)} END" for c in "xyz"}
    lines = own.selectExpr("record_id", "pos", "ca", "n", *[f"{near[c]} AS a{c}" for c in "xyz"], *[f"{far[c]} AS b{c}" for c in "xyz"])
    size = "((bx - ax) * (bx - ax) + (by - ay) * (by - ay) + (bz - az) * (bz - az))"

    def along(end: str) -> str:
        return "((" + " + ".join(f"(element_at(ca, {end}).{c} - a{c}) * (b{c} - a{c})" for c in "xyz") + f") / nullif({size}, 0e0))"

    return lines.selectExpr("record_id", "pos", *[f"a{c} + {along(at)} * (b{c} - a{c}) AS {e}{c}" for e, at in (("f", "1"), ("l", "n")) for c in "xyz"])


def helix_axis(points: np.ndarray) -> np.ndarray | None:
    """First and last point of a helix's axis: that of the best rotation of its residues onto the next ones."""
    if len(points) < 4:
        return None
    a, b = points[:-1], points[1:]
    u, _, vt = np.linalg.svd((a - a.mean(axis=0)).T @ (b - b.mean(axis=0)))
    turn = vt.T @ np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    values, vectors = np.linalg.eig(turn)
    axis = np.real(vectors[:, np.argmin(np.abs(values - 1))])
    axis /= np.linalg.norm(axis)
    if axis @ (points[-1] - points[0]) < 0:
        axis = -axis
    centre = points.mean(axis=0)
    ends = [centre + ((p - centre) @ axis) * axis for p in (points[0], points[-1])]
    return np.concatenate(ends)


def helix_axes(held: DataFrame) -> DataFrame:
    """``record_id, pos, fx..lz`` of helices; the eigenproblem has no built-in form."""
    names = [f"{e}{c}" for e in "fl" for c in "xyz"]
    own = _points(held).select("record_id", "pos", "ca")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = [helix_axis(np.array([[p["x"], p["y"], p["z"]] for p in ca], dtype=float)) for ca in batch.column("ca").to_pylist()]
            values = [[None if a is None else float(a[k]) for a in axes] for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("pos"), *[pa.array(v, pa.float64()) for v in values]], ["record_id", "pos", *names])

    return own.mapInArrow(work, StructType([*own.schema.fields[:2], *[StructField(n, DoubleType()) for n in names]]))


def strand_bonds(held: DataFrame, bonds: DataFrame, least: int = 2) -> DataFrame:
    """``record_id, i, j, bonds, code``: strand pairs with at least two bonds; t if partners come in falling order, else c.

    ``bonds`` (record_id, a, b): residue numbers, once a direction.
    """
    strands = held.where("etype = 'E'").select("record_id", "pos", "idx")
    one = strands.alias("s").join(bonds.alias("h"), (F.col("s.record_id") == F.col("h.record_id")) & (F.col("s.idx") == F.col("h.a"))).select("s.record_id", F.col("s.pos").alias("i"), "h.a", "h.b")
    both = one.alias("o").join(strands.alias("t"), (F.col("o.record_id") == F.col("t.record_id")) & (F.col("o.b") == F.col("t.idx")) & (F.col("o.i") < F.col("t.pos"))).select("o.record_id", "o.i", F.col("t.pos").alias("j"), "o.a", "o.b")
    order = F.struct("a", "b")
    found = both.groupBy("record_id", "i", "j").agg(F.count("*").alias("bonds"), F.min_by("b", order).alias("first"), F.max_by("b", order).alias("last")).where(F.col("bonds") >= least)
    return found.select("record_id", "i", "j", "bonds", F.when(F.col("first") > F.col("last"), "t").otherwise("c").alias("code"))


def ordered_elements(elements: DataFrame) -> DataFrame:
    """Adds ``pos``: chains by first appearance, helices and linkers before strands, and within a chain by begin.

    Rows carry record_id, etype, chain, begin_idx and ``at``, their place in the input; equals keep it.
    """
    group = F.when(F.col("etype") == "E", 1).otherwise(0)
    ranks = elements.groupBy("record_id", "chain").agg(F.min(F.struct(group.alias("g"), F.col("at"))).alias("first"))
    order = W.partitionBy("record_id").orderBy("first", "begin_idx", group, "at")
    return elements.join(ranks, ["record_id", "chain"]).withColumn("pos", F.row_number().over(order)).drop("first")


def without_marked(bonds: DataFrame, elements: DataFrame) -> DataFrame:
    """Bonds (record_id, a, b) no end of which lies in a strand that is marked ``excluded``."""
    marked = elements.where("excluded").select("record_id", "begin_idx", "end_idx")
    for end in ("a", "b"):
        x, m = bonds.alias("x"), marked.alias("m")
        bonds = x.join(m, (F.col("x.record_id") == F.col("m.record_id")) & F.col(f"x.{end}").between(F.col("m.begin_idx"), F.col("m.end_idx")), "left_anti")
    return bonds


def near_elements(held: DataFrame, most: float = G.MAX_DISTANCE) -> DataFrame:
    """``record_id, i, j, gap``: pairs of elements with residues within ``most`` of each other, and their least distance.

    Space is cut into cells of that width, and a residue meets those of its own cell and the 26 around it, so
    work and shuffle grow with the residues and not with their pairs, however large a structure is.
    ``held`` (record_id, pos, x, y, z) as ``residues_of`` gives it; residues without a place meet nothing.
    """
    own = held.select("record_id", "pos", "x", "y", "z", *[F.floor(F.col(c) / most).cast("int").alias(f"c{c}") for c in "xyz"]).where("cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL")
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", step)]) for step in product((-1, 0, 1), repeat=3)])
    around = own.select("*", F.explode(steps).alias("s")).select("record_id", F.col("pos").alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"s.{c}")).alias(f"c{c}") for c in "xyz"])
    met = own.withColumnRenamed("pos", "i").join(around, ["record_id", "cx", "cy", "cz"]).where("i < j")
    gap = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "yz"), (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2"))))
    return met.groupBy("record_id", "i", "j").agg(F.min(gap).alias("gap")).where(F.col("gap") <= most)


def within_reach(a: str, b: str, most: float) -> str:
    """Whether any residues of two elements (arrays of points) lie within ``most`` of each other; stops at the first pair."""
    gap = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in "xyz")
    return f"exists({a}, p -> exists({b}, q -> sqrt({gap}) <= {most}e0))"


def _axis_of(ca: str) -> str:
    """``strand_axes`` as one expression over an element's residues, for use inside a record's row."""

    def mid(a: str, b: str, c: str) -> str:
        return f"((get({ca}, {a} - 1).{c} + get({ca}, {b} - 1).{c}) / 2e0)"

    def line(v: dict[str, str]) -> str:
        n, k = v["n"], v["k"]
        near = {f"a{c}": f"CASE WHEN {n} = 2 THEN get({ca}, 0).{c} ELSE {mid(k, f'{k} + 1', c)} END" for c in "xyz"}
        far = {f"b{c}": f"CASE WHEN {n} = 2 THEN get({ca}, 1).{c} ELSE {mid(f'{n} - {k}', f'{n} - {k} + 1', c)} END" for c in "xyz"}
        return G.let(near | far, lambda w: feet(w, n), True, "w")

    def feet(w: dict[str, str], n: str) -> str:
        size = "(" + " + ".join(f"({w[f'b{c}']} - {w[f'a{c}']}) * ({w[f'b{c}']} - {w[f'a{c}']})" for c in "xyz") + ")"
        along = {e: "((" + " + ".join(f"(get({ca}, {at} - 1).{c} - {w[f'a{c}']}) * ({w[f'b{c}']} - {w[f'a{c}']})" for c in "xyz") + f") / nullif({size}, 0e0))" for e, at in (("f", "1"), ("l", n))}
        return G.let(along, lambda z: "named_struct(" + ", ".join(f"'{e}{c}', {w[f'a{c}']} + {z[e]} * ({w[f'b{c}']} - {w[f'a{c}']})" for e in "fl" for c in "xyz") + ")", True, "z")

    bound = G.let({"n": f"size({ca})", "k": f"cast(CASE WHEN size({ca}) > 3 THEN floor(size({ca}) / 3) ELSE 1 END as int)"}, line, True, "v")
    return f"CASE WHEN size({ca}) >= 2 THEN {bound} END"


def _with_helices(own: DataFrame) -> DataFrame:
    """Adds ``axes``: axis ends of each helix in ``helices`` (lists of points) of a record; other columns pass as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fitted = [[None if a is None else a.tolist() for a in (helix_axis(np.array(points, dtype=float).reshape(-1, 3)) for points in helices)] for helices in batch.column("helices").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "axes"])

    return own.mapInArrow(work, StructType([*own.schema.fields, StructField("axes", ArrayType(ArrayType(DoubleType())))])).drop("helices")


def structures(lines: DataFrame) -> DataFrame:
    """``record_id, residues, cards, pairs``: every line read once, and one row a structure, by one shuffle.

    A structure's own lines meet in a row.  Residues are distinct by chain and label, in order up to the
    first ENDMDL; cards and pairs are as ``sources.ssd`` reads them.
    """
    atom, card, pair, end = ssd.atom_of(), ssd.card_of(), ssd.pair_of(), F.col("line").startswith("ENDMDL")
    own = lines.select(F.col("file").alias("record_id"), "at", atom.alias("atom"), card.alias("card"), pair.alias("pair"), F.when(end, F.col("at")).alias("ended"))
    own = own.where("atom IS NOT NULL OR card IS NOT NULL OR pair IS NOT NULL OR ended IS NOT NULL")
    return own.groupBy("record_id").agg(F.min("ended").alias("ended"), *[F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct("at", F.col(x).alias("of"))))).alias(f"{x}s") for x in ("atom", "card", "pair")])


def build_records(lines: DataFrame) -> DataFrame:
    """``record_id, n, elements, sheets, rows`` of structure cards (file, at, line): the whole way from text to codes.

    Elements get residues by their labels, are ordered and the short ones dropped; axes are fitted; strands
    with two bonds or more are t or c; other pairs in contact by axes and residues are u, v or N by their
    angle, but '-' within one sheet.  A file without elements gives no record.

    One scan and one shuffle: a structure's lines become arrays of one row, and all that follows stays in it.
    """
    one = structures(lines).selectExpr("record_id", "transform(filter(atoms, x -> ended IS NULL OR x.at < ended), x -> x.of) AS atoms", "cards", "pairs")
    # residues by first appearance, numbered from 2
    one = one.selectExpr("record_id", "cards", "pairs", "atoms", "transform(atoms, x -> concat(x.chain, ' ', trim(x.label))) AS keys")
    first = "CASE WHEN size(array_distinct(keys)) = size(keys) THEN atoms ELSE filter(atoms, (x, i) -> array_position(keys, concat(x.chain, ' ', trim(x.label))) = i + 1) END"
    one = one.selectExpr("record_id", "cards", "pairs", f"transform({first}, (x, i) -> named_struct('idx', i + 2, 'chain', x.chain, 'x', x.x, 'y', x.y, 'z', x.z)) AS residues", "array_distinct(keys) AS keys")

    def idx(k: str, chain: str, label: str) -> str:
        return f"nullif(cast(array_position({k}, concat({chain}, ' ', trim({label}))) as int), 0) + 1"

    found = G.let({"keys": "keys"}, lambda v: f"filter(transform(cards, c -> named_struct('at', c.at, 'etype', c.of.etype, 'chain', c.of.chain, 'begin_label', trim(c.of.begin_label), 'end_label', trim(c.of.end_label), 'length', c.of.length, 'sheet', c.of.sheet, 'excluded', c.of.excluded, 'begin_idx', {idx(v['keys'], 'c.of.chain', 'c.of.begin_label')}, 'end_idx', {idx(v['keys'], 'c.of.chain', 'c.of.end_label')})), c -> c.begin_idx IS NOT NULL AND c.end_idx IS NOT NULL)", True, "t")
    ends = G.let({"keys": "keys"}, lambda v: f"transform(pairs, p -> named_struct('a', {idx(v['keys'], 'p.of.a_chain', 'p.of.a_label')}, 'b', {idx(v['keys'], 'p.of.b_chain', 'p.of.b_label')}))", True, "t")
    one = one.selectExpr("record_id", "residues", f"{found} AS cards", f"{ends} AS ends")
    kept = f"filter(cards, c -> (c.etype = 'H' AND c.length >= {LEAST_HELIX}) OR (c.etype = 'E' AND c.length >= {LEAST_STRAND}) OR (c.etype = 'L' AND c.length >= {LEAST_LINKER}))"
    # bonds in both directions, none with an end in a marked strand
    both = G.let({"marked": "filter(cards, c -> c.etype = 'E' AND c.excluded)"}, lambda v: f"filter(array_distinct(flatten(transform(ends, p -> array(p, named_struct('a', p.b, 'b', p.a))))), p -> p.a IS NOT NULL AND p.b IS NOT NULL AND NOT exists({v['marked']}, m -> p.a BETWEEN m.begin_idx AND m.end_idx OR p.b BETWEEN m.begin_idx AND m.end_idx))", True, "t")
    one = one.selectExpr("record_id", "residues", f"{kept} AS cards", f"{both} AS bonds")
    # chains by first appearance, helices and linkers before strands, then by begin
    rank = "CASE WHEN {}.etype = 'E' THEN 1 ELSE 0 END"
    placed = G.let({"cards": "cards"}, lambda v: f"transform(array_sort(transform({v['cards']}, c -> named_struct('first', array_min(transform(filter({v['cards']}, d -> d.chain = c.chain), d -> named_struct('g', {rank.format('d')}, 'at', d.at))), 'begin_idx', c.begin_idx, 'g', {rank.format('c')}, 'at', c.at, 'card', c))), x -> x.card)", True, "t")
    one = one.selectExpr("record_id", "residues", "bonds", f"{placed} AS cards").where("size(cards) > 0")
    held = G.let({"residues": "residues"}, lambda v: f"transform(cards, (c, i) -> named_struct('pos', i + 1, 'card', c, 'ca', filter({v['residues']}, r -> r.chain = c.chain AND r.idx BETWEEN c.begin_idx AND c.end_idx)))", True, "t")
    one = one.selectExpr("record_id", "bonds", f"{held} AS own")
    one = _with_helices(one.withColumn("helices", F.expr("transform(filter(own, e -> e.card.etype = 'H'), e -> transform(e.ca, r -> array(r.x, r.y, r.z)))")))
    point = ", ".join(f"'{e}{c}', get(h, {3 * k + d})" for k, e in enumerate("fl") for d, c in enumerate("xyz"))
    fields = ("etype", "chain", "begin_label", "end_label", "length")
    # the n-th helix of a record has the n-th fitted axis
    nth = "size(filter(slice(t.own, 1, e.pos), o -> o.card.etype = 'H')) - 1"
    helix = f"element_at(transform(array(get(t.axes, {nth})), h -> named_struct({point})), 1)"
    axis = f"CASE WHEN e.card.etype = 'H' THEN {helix} ELSE {_axis_of('e.ca')} END"
    with_axes = G.let({"own": "own", "axes": "axes"}, lambda v: f"transform({v['own']}, e -> named_struct('pos', e.pos, 'card', e.card, 'ca', e.ca, 'axis', {axis}))", True, "t")
    flat = ", ".join([f"'{f}', e.card.{f}" for f in fields] + [f"'{e}{c}', e.axis.{e}{c}" for e in "fl" for c in "xyz"])
    one = one.selectExpr("record_id", "bonds", f"transform({with_axes}, e -> named_struct('pos', e.pos, 'sheet', e.card.sheet, 'begin_idx', e.card.begin_idx, 'end_idx', e.card.end_idx, 'ca', e.ca, 'at', named_struct({flat}))) AS own")
    holds = "exists({0}.ca, r -> r.idx = {1})"
    strands = "filter(own, e -> e.at.etype = 'E')"
    links = G.let({"strands": strands}, lambda v: f"array_sort(flatten(transform(bonds, p -> flatten(transform(filter({v['strands']}, s -> {holds.format('s', 'p.a')}), s -> transform(filter({v['strands']}, u -> u.pos > s.pos AND {holds.format('u', 'p.b')}), u -> named_struct('i', s.pos, 'j', u.pos, 'a', p.a, 'b', p.b)))))))", True, "t")
    one = one.selectExpr("record_id", "own", f"{links} AS links")
    strand_pair, same = "(a.at.etype = 'E' AND b.at.etype = 'E')", "coalesce(a.sheet = b.sheet, false)"

    def code(v: dict[str, str]) -> str:
        met = f"filter({v['links']}, l -> l.i = a.pos AND l.j = b.pos)"
        turn = G.let({"d": G.angle("a.at", "b.at")}, lambda w: f"CASE WHEN {w['d']} > {G.ANTIPARALLEL_ABOVE}e0 THEN 'v' WHEN {w['d']} < {G.PARALLEL_BELOW}e0 THEN 'u' ELSE 'N' END", True, "g")
        free = f"CASE WHEN NOT ({strand_pair} AND {same}) AND {within_reach('a.ca', 'b.ca', G.MAX_DISTANCE)} AND {G.overlap('a.at', 'b.at', bind=True)} > {G.MIN_OVERLAP}e0 THEN {turn} ELSE '-' END"
        return G.let({"met": met}, lambda w: f"CASE WHEN size({w['met']}) >= 2 THEN CASE WHEN get({w['met']}, 0).b > get({w['met']}, size({w['met']}) - 1).b THEN 't' ELSE 'c' END ELSE {free} END", True, "f")

    rows = G.let({"own": "own", "links": "links"}, lambda v: f"transform({v['own']}, (a, i) -> concat('*', array_join(transform(slice({v['own']}, i + 2, size({v['own']})), b -> {code(v)}), '')))", True, "t")
    names = "array_distinct(filter(transform(own, e -> e.sheet), s -> s IS NOT NULL AND s <> ''))"
    return one.selectExpr("record_id", "size(own) AS n", "transform(own, e -> e.at) AS elements", f"transform({names}, s -> transform(filter(own, e -> e.sheet = s), e -> e.pos)) AS sheets", f"{rows} AS rows")
