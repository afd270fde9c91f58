"""Motif search: level-wise expansion inside record rows.

A record holds its elements and code rows as arrays, so after reading there is no shuffle: every
level explodes the later elements that satisfy the next slot's type, length and chain and all
its codes with elements picked before, and constraints apply as soon as their elements are bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.functions import geometry as G
from foldlattice.functions.codes import code_matches, type_matches
from foldlattice.plans.motif import Motif


def code_at(rows: str, i: str, j: str) -> str:
    """Code between elements i < j (from 1) of packed rows: row i starts at its own diagonal."""
    return f"substring(element_at({rows}, {i}), {j} - {i} + 1, 1)"


def composition(records: DataFrame) -> DataFrame:
    """Adds how many elements of each type a record has."""
    return records.withColumns({f"n_{t}": F.expr(f"size(filter(elements, e -> e.etype = '{t}'))") for t in "HEL"})


def form_of(hand: tuple) -> tuple[int, ...]:
    """How the places of a handedness line stand to their ascending order, from 0."""
    order = sorted(hand[:3])
    return tuple(order.index(x) for x in hand[:3])


def senses_sql(form: tuple[int, ...]) -> str:
    """For each pair i < j of elements the senses of (i, j, m), m from j + 1 on, in the order of ``form``; blank senses are '-'.

    ``functions.geometry.chirality`` over directions and middles that are found once an element.
    """
    axis = ", ".join(f"'d{k}', {d}, 'm{k}', (e.f{k} + e.l{k}) / 2e0" for k, d in zip(G.AXES, G.direction("e")))
    a, b, c = ("xyz"[k] for k in form)

    def way(e: str) -> list[str]:
        return [f"{e}.d{k}" for k in G.AXES]

    first = {f"s{e}": f"CASE WHEN {G.dot(way(a), way(e))} < 0e0 THEN -1e0 ELSE 1e0 END" for e in (b, c)} | {f"{e}{k}": f"({e}.m{k} - {a}.m{k})" for e in (b, c) for k in G.AXES}

    def vectors(v: dict[str, str]) -> str:
        mean = {f"n{k}": f"({p} + {v[f's{b}']} * {q} + {v[f's{c}']} * {r})" for k, p, q, r in zip(G.AXES, way(a), way(b), way(c))}
        turn = {f"t{k}": x for k, x in zip(G.AXES, G.cross([v[f"{b}{k}"] for k in G.AXES], [v[f"{c}{k}"] for k in G.AXES]))}
        return G.let(mean | turn, lambda w: G.let({"sense": G.angle_of([w[f"n{k}"] for k in G.AXES], [w[f"t{k}"] for k in G.AXES])}, letter, True, "u"), True, "w")

    def letter(w: dict[str, str]) -> str:
        return f"CASE WHEN {w['sense']} < 90e0 THEN 'R' WHEN {w['sense']} > 90.001e0 THEN 'L' ELSE '-' END"

    row = f"array_join(transform(slice(axes, i + j + 3, size(axes)), z -> {G.let(first, vectors, True, 'v')}), '')"
    pairs = f"transform(axes, (x, i) -> transform(slice(axes, i + 2, size(axes)), (y, j) -> {row}))"
    return f"element_at(transform(array(transform(elements, e -> named_struct({axis}))), axes -> {pairs}), 1)"


def sense_at(form: str, i: str, j: str, m: str) -> str:
    """The sense of elements i < j < m (from 1) in what ``senses_sql`` gave, null where one isn't there."""
    return f"substring(get(get({form}, {i} - 1), {j} - {i} - 1), {m} - {j}, 1)"


def _ready(motif: Motif, level: int) -> list[str]:
    """Conditions over picked elements e1..e<level> whose last element is bound at this level."""
    out = []
    for r in motif.requirements:
        if not r.elements or max(r.elements) != level or r.kind == "length":
            continue
        own = [f"e{i}" for i in r.elements]
        if r.kind == "chainS":
            out += [f"{e}.chain = {own[0]}.chain" for e in own[1:]]
        elif r.kind == "chainD":
            out.append("(" + " OR ".join(f"{e}.chain <> {own[0]}.chain" for e in own[1:]) + ")")
        elif r.kind in ("sheetS", "sheetD"):
            same = f"(size(sheets) = 0 OR exists(sheets, s -> {' AND '.join(f'array_contains(s, p{i})' for i in r.elements)}))"
            out.append(same if r.kind == "sheetS" else f"NOT {same}")
        elif r.kind in ("parallel", "antiparallel"):
            i, j = r.elements
            # null-safe: else a null check of ``parity`` goes below whatever makes it and makes it twice
            out.append(f"coalesce(array_contains(parity, concat(p{i}, '-', p{j}, '={0 if r.kind == 'parallel' else 1}')), false)")
    return out


def search(records: DataFrame, motif: Motif) -> DataFrame:
    """``query_id, record_id, motif_idx, positions`` of each strictly increasing match.

    ``records`` (record_id, n, elements, rows[, sheets]): elements are structs with at least etype,
    chain and length, ``rows`` packed code rows.  Records too small or lacking the needed types are
    dropped first.  ``motif_idx`` numbers a record's matches from the last to the first.
    """
    needed = {t: motif.types.count(t) for t in "HEL"}
    now = composition(records).where(F.col("n") >= motif.k).where(" AND ".join(f"n_{t} >= {c}" for t, c in needed.items())).drop("n_H", "n_E", "n_L")
    kinds = {r.kind for r in motif.requirements}
    now = now.select("record_id", "n", "elements", "rows", *["sheets"] * bool(kinds & {"sheetS", "sheetD"}), *["parity"] * bool(kinds & {"parallel", "antiparallel"}))
    forms = {f: f"senses_{''.join(map(str, f))}" for f in sorted({form_of(h) for h in motif.handedness})}
    now = now.withColumns({name: F.expr(senses_sql(f)) for f, name in forms.items()})
    for level in range(1, motif.k + 1):
        own = "element_at(elements, p)"
        when = [type_matches(f"{own}.etype", f"'{motif.types[level - 1]}'")]
        when += [f"{own}.length BETWEEN {low} AND {high}" for low, high in motif.lengths(level)]
        if level > 1 and motif.one_chain:
            when.append(f"{own}.chain = e1.chain")
        when += [code_matches(code_at("rows", f"p{i}", "p"), f"'{motif.codes[i, level]}'") for i in range(1, level) if motif.codes[i, level] != "X"]
        first = f"p{level - 1} + 1" if level > 1 else "1"
        last = f"n - {motif.k - level}"
        # outer: else Spark adds a filter on the same list's size and makes it twice
        now = now.where(f"{first} <= {last}").select(*now.columns, F.explode_outer(F.expr(f"filter(sequence({first}, {last}), p -> {' AND '.join(when)})")).alias(f"p{level}")).where(f"p{level} IS NOT NULL")
        now = now.withColumn(f"e{level}", F.expr(f"element_at(elements, p{level})"))
        for condition in _ready(motif, level):
            now = now.where(condition)
        for h in motif.handedness:
            if max(h[:3]) == level:
                now = now.where(f"{sense_at(forms[form_of(h)], *(f'p{i}' for i in sorted(h[:3])))} <=> '{h[3]}'")
    picked = [f"p{i}" for i in range(1, motif.k + 1)]
    # all matches of a record stem from one row, so this window needs one exchange of short rows
    order = W.partitionBy("record_id").orderBy(*[F.desc(p) for p in picked])
    return now.select("record_id", *picked).select(F.lit(motif.motif_id).alias("query_id"), "record_id", F.row_number().over(order).alias("motif_idx"), F.concat_ws(",", *picked).alias("positions"))


def parity_of_sheets(records: DataFrame) -> DataFrame:
    """Adds ``parity``, an array of 'i-j=t' for all pairs i < j joined within a record by c and t contacts.

    t is the number of t contacts along a shortest path modulo two, the even one among equals.  From each
    element a front of (element, parity) moves one contact at a time over what it has not met, until it
    is empty; all of it stays in the record's row.
    """
    edge = "transform(filter(sequence(1, size(t.rows)), y -> y <> x AND instr('ct', {0}) > 0), y -> named_struct('y', y, 't', CASE WHEN {0} = 't' THEN 1 ELSE 0 END))".format(code_at("t.rows", "least(x, y)", "greatest(x, y)"))
    near = f"element_at(transform(array(named_struct('rows', rows)), t -> transform(sequence(1, size(t.rows)), x -> {edge})), 1)"
    reached = "flatten(transform(s.front, f -> transform(filter(element_at(u.near, f.y), e -> NOT array_contains(s.seen, e.y)), e -> named_struct('y', e.y, 't', (f.t + e.t) % 2))))"
    # sorted, the first of an element's entries is the even one
    fresh = G.let({"all": f"array_sort(array_distinct({reached}))"}, lambda v: f"filter({v['all']}, (c, i) -> i = 0 OR get({v['all']}, i - 1).y <> c.y)", True, "d")
    step = G.let({"front": fresh}, lambda v: f"CASE WHEN size({v['front']}) = 0 THEN named_struct('front', {v['front']}, 'seen', s.seen, 'out', s.out) ELSE named_struct('front', {v['front']}, 'seen', concat(s.seen, transform({v['front']}, f -> f.y)), 'out', concat(s.out, {v['front']})) END", True, "z")
    begun = "named_struct('front', array(named_struct('y', x, 't', 0)), 'seen', array(x), 'out', cast(array() as array<struct<y:int,t:int>>))"
    walk = f"aggregate(sequence(1, greatest(size(u.near) - 1, 1)), {begun}, (s, k) -> CASE WHEN size(s.front) = 0 THEN s ELSE {step} END, s -> filter(s.out, f -> f.y > x))"
    found = f"flatten(transform(sequence(1, size(u.near)), x -> CASE WHEN size(element_at(u.near, x)) = 0 THEN cast(array() as array<string>) ELSE transform(array_sort({walk}), f -> concat(x, '-', f.y, '=', f.t)) END))"
    return records.withColumn("parity", F.expr(f"CASE WHEN size(rows) > 0 THEN element_at(transform(array(named_struct('near', {near})), u -> {found}), 1) ELSE cast(array() as array<string>) END"))
