"""Many motifs in one pass: a trie of motifs walked by growing subsets of each record's elements.

Motifs that agree in their first elements (types, codes, lengths, chains, sheets, handedness) share
a path.  A row is a subset of a record's elements with one trie node that it satisfies; the next
element is exploded and meets the node's edges in an equi-join on (node, type) whose rest is bit
tests.  A subset that no motif can continue has no row, so work follows partial matches and not the
number of subsets, and motifs of different sizes share the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.functions.codes import RECORD_CODES
from foldlattice.operators.search import form_of, sense_at, senses_sql
from foldlattice.plans.motif import Motif

#: Bits of the codes that a record can hold; a motif's code is the set of bits that it accepts (fixed values).
CODE_BITS = {c: 1 << k for k, c in enumerate(RECORD_CODES)}
ACCEPTED = {"X": "".join(RECORD_CODES), "x": "ctuvN", "T": "vt", "C": "uc"}
#: Pairs whose codes share one 64-bit number, conditions that do, and triples with two senses each.
PAIRS, FLAGS, TRIPLES = 10, 62, 31
#: Edges up to which a level's table is sent to every task; larger ones are joined as Spark decides.
SENT_EDGES = 1_000_000
#: Parts that a task's share of the work is cut into where records are dealt out.
UNITS = 16
FREE = 1 << 30


@dataclass(frozen=True)
class Step:
    """What a motif asks of its element at one level, given the ones before."""

    etype: str
    codes: tuple[int, ...]
    low: int
    high: int
    need: frozenset
    ban: frozenset
    hands: frozenset


@dataclass
class Node:
    level: int
    number: int
    steps: dict[Step, Node] = field(default_factory=dict)
    ends: list[str] = field(default_factory=list)

    @property
    def left(self) -> int:
        """Fewest further elements to a whole motif."""
        return 0 if self.ends else 1 + min(n.left for n in self.steps.values())


def steps_of(motif: Motif) -> list[tuple[str, Step]]:
    """The motif's steps; each condition stands at the first level that can refute it."""
    need: dict[int, set] = {i: set() for i in range(1, motif.k + 1)}
    ban: dict[int, set] = {i: set() for i in range(1, motif.k + 1)}
    if motif.one_chain:
        for i in range(2, motif.k + 1):
            need[i].add(("chain", (1, i)))
    for r in motif.requirements:
        own = tuple(sorted(set(r.elements)))
        if r.kind == "chainS":
            for i in own[1:]:
                need[i].add(("chain", (own[0], i)))
        elif r.kind == "sheetS":
            for at in range(1, len(own)):
                need[own[at]].add(("sheet", own[: at + 1]))
        elif r.kind in ("chainD", "sheetD"):
            ban[own[-1]].add((r.kind[:-1], own))
        elif r.kind in ("parallel", "antiparallel"):
            need[own[-1]].add((r.kind, own))
    out = []
    for i in range(1, motif.k + 1):
        codes = tuple(sum(CODE_BITS[c] for c in ACCEPTED.get(motif.codes[j, i], motif.codes[j, i])) for j in range(1, i))
        low, high = max((lo for lo, _ in motif.lengths(i)), default=0), min((hi for _, hi in motif.lengths(i)), default=FREE)
        hands = frozenset(h for h in motif.handedness if max(h[:3]) == i)
        out.append((motif.types[i - 1], Step("", codes, low, high, frozenset(need[i]), frozenset(ban[i]), hands)))
    return out


def motif_trie(motifs: list[Motif]) -> list[list[Node]]:
    """Nodes by level; a free type stands for one path a type."""
    levels: list[list[Node]] = [[Node(0, 0)]]
    number = 0
    for m in motifs:
        steps = steps_of(m)
        for types in product(*("HEL" if t == "X" else t for t, _ in steps)):
            node = levels[0][0]
            for t, (_, s) in zip(types, steps):
                s = Step(t, s.codes, s.low, s.high, s.need, s.ban, s.hands)
                if s not in node.steps:
                    number += 1
                    node.steps[s] = Node(node.level + 1, number)
                    if len(levels) <= node.level + 1:
                        levels.append([])
                    levels[node.level + 1].append(node.steps[s])
                node = node.steps[s]
            node.ends.append(m.motif_id)
    return levels


def _masks(bits: list[int], most: int, wide: int) -> list[int]:
    """Numbers of ``most`` fields of ``wide`` bits each."""
    return [sum(a << wide * k for k, a in enumerate(bits[b : b + most])) for b in range(0, len(bits), most)]


def _condition_sql(kind: str, places: tuple[int, ...]) -> str:
    if kind == "chain":
        return " AND ".join(f"c{i} = c{places[0]}" for i in places[1:])
    if kind == "sheet":  # an element's sheets are bits of its w
        return f"({' & '.join(f'w{i}' for i in places)}) <> 0"
    i, j = places
    return f"array_contains(parity, concat(p{i}, '-', p{j}, '={0 if kind == 'parallel' else 1}'))"


def _flags_sql(flags: list[tuple], k: int) -> str:
    """A number with a bit for each condition that holds.

    All sheet conditions hold where a record has no sheets; where it has more than a number has bits, they
    are looked up in the sheets themselves.
    """
    parts = {True: [], False: []}
    for at, f in enumerate(flags):
        parts[f[0] == "sheet"].append(f"CASE WHEN {_condition_sql(*f)} THEN {1 << at}L ELSE 0L END")
    out = list(parts[False])
    if parts[True]:
        own = [(1 << at, f[1]) for at, f in enumerate(flags) if f[0] == "sheet"]
        listed = ", ".join(f"named_struct('bit', {bit}L, 'places', array({', '.join(map(str, places))}))" for bit, places in own)
        picked = ", ".join(f"p{i}" for i in range(1, k + 1))
        looked = f"aggregate(filter(array({listed}), f -> exists(sheets, s -> forall(f.places, i -> array_contains(s, element_at(array({picked}), i))))), 0L, (a, f) -> a | f.bit)"
        out.append(f"CASE WHEN size(sheets) = 0 THEN {sum(bit for bit, _ in own)}L WHEN size(sheets) < 63 THEN ({' | '.join(parts[True])}) ELSE {looked} END")
    return " | ".join(out)


def _sense_bits(at: int, form: str, places: list[int]) -> str:
    return f"CASE {sense_at(form, *(f'p{x}' for x in places))} WHEN 'R' THEN {1 << 2 * at}L WHEN 'L' THEN {2 << 2 * at}L ELSE 0L END"


def ends_count(levels: list[list[Node]]) -> int:
    return sum(len(n.ends) for level in levels for n in level)


def _code(i: str, j: str) -> str:
    """The code of a pair that is null for an element that isn't there."""
    return f"substring(get(rows, {i} - 1), {j} - {i} + 1, 1)"


def _or(terms: list[str]) -> str:
    return f"coalesce({' | '.join(terms)}, 0L)" if terms else "0L"


def _cost(n: str, k: int) -> str:
    """Subsets of k out of n, as a floating number."""
    return "(" + " * ".join(f"greatest(cast({n} - {i} as double), 0e0)" for i in range(k)) + f" / {math.factorial(k)}e0)" if k else "1e0"


def deal(records: DataFrame, k: int, tasks: int) -> DataFrame:
    """Records with a share of the first places each: ``q_from, q_to`` and the second places that leave ``part`` by ``parts``.

    A record of m fitting elements costs C(m, k).  ``tasks`` times ``UNITS`` parts of the whole cost would be
    even; records below that stay where they are, others are cut into units of at most that cost (or one
    pair of first places) and dealt out by hash.  Only the whole cost, one number, is seen by the driver.
    """
    held = records.withColumn("m", F.size("fit"))
    whole = held.agg(F.sum(F.expr(_cost("m", k)))).first()[0] or 0.0
    unit = max(whole / (tasks * UNITS), 1.0)
    held = held.withColumn("whole_cost", F.expr(_cost("m", k)))
    light = held.where(F.col("whole_cost") <= unit).select("*", F.lit(1).alias("q_from"), F.col("m").alias("q_to"), F.lit(1).alias("parts"), F.lit(0).alias("part"))
    # the last first places together cost at most a unit; each one before is cut by its second places
    tail = F.expr(f"size(filter(sequence(1, m), q -> {_cost('(m - q + 1)', k)} > {unit:.1f}e0)) + 1")
    heavy = held.where(F.col("whole_cost") > unit).withColumn("tail", tail)
    cut = heavy.withColumn("q_from", F.explode(F.expr("sequence(1, least(tail, m))"))).withColumn("q_to", F.expr("CASE WHEN q_from = tail THEN m ELSE q_from END"))
    parts = F.when(F.col("q_from") == F.col("tail"), 1).otherwise(F.greatest(F.lit(1), F.least(F.col("m"), F.ceil(F.expr(_cost("(m - q_from)", k - 1)) / unit).cast("int"))))
    cut = cut.withColumn("parts", parts).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("tail")
    return light.unionByName(cut.repartition(tasks, "record_id", "q_from", "part")).drop("m", "whole_cost")


def sweep(records: DataFrame, motifs: list[Motif], tasks: int | None = None) -> DataFrame:
    """``query_id, record_id, positions`` of many motifs of any sizes, with all their constraints, in one scan.

    ``records`` as for ``search``, with ``sheets`` or ``parity`` (``parity_of_sheets``) where a motif asks for
    them and points in elements for handedness; a record's senses are found once, whatever the number
    of motifs.  With ``tasks``, records whose work passes a small part of a task's share are cut by
    their first places and dealt out (``deal``); without, there is no shuffle.
    """
    if not motifs:
        raise ValueError("no motifs")
    levels = motif_trie(motifs)
    most = len(levels) - 1
    spark = records.sparkSession
    every = [s for level in levels for n in level for s in n.steps]
    flags = {L: sorted({f for n in levels[L - 1] for s in n.steps for f in s.need | s.ban}) for L in range(1, most + 1)}
    triples = {L: sorted({h[:3] for n in levels[L - 1] for s in n.steps for h in s.hands}) for L in range(1, most + 1)}
    kinds = {kind for own in flags.values() for kind, _ in own}
    forms = {f: f"senses_{''.join(map(str, f))}" for f in sorted({form_of(t) for own in triples.values() for t in own})}

    limits: dict[str, tuple[int, int]] = {}
    for s in every:
        low, high = limits.get(s.etype, (s.low, s.high))
        limits[s.etype] = min(s.low, low), max(s.high, high)
    fits = " OR ".join(f"(e.etype = '{t}' AND e.length BETWEEN {lo} AND {hi})" for t, (lo, hi) in sorted(limits.items()))
    # over ``elements`` and not over places: the filter below goes under what makes them, which a place would make again each
    own = records.withColumn("fit", F.expr(f"filter(transform(elements, (e, i) -> CASE WHEN {fits} THEN i + 1 END), p -> p IS NOT NULL)"))
    own = own.where(f"n > 0 AND size(fit) >= {levels[0][0].left}")
    columns = ["record_id", "fit", "rows", *[F.expr(f"transform(elements, e -> e.{c})").alias(a) for c, a in (("etype", "etypes"), ("chain", "chains"), ("length", "lengths"))]]
    columns += ["parity"] * bool(kinds & {"parallel", "antiparallel"})
    if "sheet" in kinds:
        columns += ["sheets", F.expr("transform(sequence(1, n), p -> aggregate(sequence(1, least(size(sheets), 62)), 0L, (a, s) -> a | CASE WHEN size(sheets) > 0 AND array_contains(element_at(sheets, s), p) THEN shiftleft(1L, s - 1) ELSE 0L END))").alias("within")]
    own = own.select(*columns, *[F.expr(senses_sql(f)).alias(name) for f, name in forms.items()])
    carried = own.columns
    if tasks is None:
        now = own.select("*", F.lit(1).alias("q_from"), F.size("fit").alias("q_to"), F.lit(1).alias("parts"), F.lit(0).alias("part"))
    else:
        now = deal(own, most, tasks)
    now = now.withColumns({"node": F.lit(0), "left": F.lit(levels[0][0].left), "ends": F.lit(False), "q0": F.lit(0)})

    for L in range(1, most + 1):
        edges = []
        for n in levels[L - 1]:
            for s, child in n.steps.items():
                need, ban = (_masks([int(f in own) for f in flags[L]], FLAGS, 1) for own in (s.need, s.ban))
                sense = {h[:3]: 1 if h[3] == "R" else 2 for h in s.hands}
                hands = _masks([sense.get(t, 0) for t in triples[L]], TRIPLES, 2)
                edges.append((n.number, s.etype, _masks(list(s.codes), PAIRS, 6), s.low, s.high, need, ban, hands, child.number, child.left, bool(child.ends) and bool(child.steps)))
        # rows of whole motifs stay as they are while larger motifs go on
        for n in (n for level in levels[:L] for n in level if n.ends):
            edges.append((n.number, ".", [-1] * -(-(L - 1) // PAIRS), 0, FREE, *([0] * -(-len(x) // y) for x, y in ((flags[L], FLAGS), (flags[L], FLAGS), (triples[L], TRIPLES))), n.number, 0, False))
        table = spark.createDataFrame(edges, "parent int, kind string, accepted array<long>, low int, high int, need array<long>, ban array<long>, hands array<long>, child int, child_left int, child_ends boolean")
        if len(edges) <= SENT_EDGES:
            table = F.broadcast(table)
        first, last = ("q_from", "q_to") if L == 1 else (f"q{L - 1} + 1", "size(fit)")
        going = f"CASE WHEN {first} <= least({last}, size(fit) - left + 1) THEN sequence({first}, least({last}, size(fit) - left + 1)) ELSE cast(array() as array<int>) END"
        if L == 2:
            going = f"filter({going}, q -> parts = 1 OR pmod(q, parts) = part)"
        stays = "array(0)" if L > 1 else "cast(array() as array<int>)"
        # left = 0 and no way on: a whole motif; ends: whole, and a part of larger ones
        options = f"CASE WHEN left = 0 AND NOT ends THEN {stays} WHEN ends THEN concat({stays}, {going.replace('size(fit) - left + 1', 'size(fit)')}) ELSE {going} END"
        # outer: else Spark adds a filter on the same list's size and makes it twice
        now = now.select("*", F.explode_outer(F.expr(options)).alias(f"q{L}")).where(f"q{L} IS NOT NULL")
        now = now.withColumn(f"p{L}", F.expr(f"CASE WHEN q{L} = 0 THEN 0 ELSE get(fit, q{L} - 1) END"))
        now = now.withColumns({"t": F.expr(f"CASE WHEN q{L} = 0 THEN '.' ELSE get(etypes, p{L} - 1) END"), "size_": F.expr(f"coalesce(get(lengths, p{L} - 1), 0)"), f"c{L}": F.expr(f"get(chains, p{L} - 1)")})
        if "sheet" in kinds:
            now = now.withColumn(f"w{L}", F.expr(f"get(within, p{L} - 1)"))
        codes = [f"shiftleft(1L, instr('{RECORD_CODES}', {_code(f'p{i}', f'p{L}')}) - 1 + {6 * ((i - 1) % PAIRS)})" for i in range(1, L)]
        bits = {f"m{b}": _or(codes[b * PAIRS : (b + 1) * PAIRS]) for b in range(-(-len(codes) // PAIRS))}
        bits |= {f"h{b}": f"coalesce({_flags_sql(flags[L][b * FLAGS : (b + 1) * FLAGS], L)}, 0L)" for b in range(-(-len(flags[L]) // FLAGS))}
        for b in range(-(-len(triples[L]) // TRIPLES)):
            bits[f"s{b}"] = _or([_sense_bits(at, forms[form_of(t)], sorted(t)) for at, t in enumerate(triples[L][b * TRIPLES : (b + 1) * TRIPLES])])
        now = now.withColumns({k: F.expr(v) for k, v in bits.items()})
        on = ["a.node = o.parent", "a.t = o.kind", "a.size_ BETWEEN o.low AND o.high"]
        for name in bits:
            at, b = name[0], f"get(o.{{}}, {name[1:]})"
            if at == "m":
                on.append(f"a.{name} & {b.format('accepted')} = a.{name}")
            elif at == "h":
                on += [f"a.{name} & {b.format('need')} = {b.format('need')}", f"a.{name} & {b.format('ban')} = 0"]
            else:
                on.append(f"a.{name} & {b.format('hands')} = {b.format('hands')}")
        if any(-1 in e[2] for e in edges):  # a whole motif's row has no codes with what it lacks
            on = [c if "accepted" not in c else f"(a.t = '.' OR {c})" for c in on]
        met = now.alias("a").join(table.alias("o"), F.expr(" AND ".join(f"({c})" for c in on)))
        kept = [c for c in now.columns if c not in {"node", "left", "ends", "t", "size_", "q_from", "q_to", f"q{L - 1}", *bits} and not (L >= 2 and c in ("parts", "part")) and not (L == most and c in {*carried, *[f"{x}{i}" for x in "cw" for i in range(1, L + 1)]} - {"record_id"})]
        now = met.select(*[f"a.{c}" for c in kept], F.col("o.child").alias("node"), F.col("o.child_left").alias("left"), F.col("o.child_ends").alias("ends"))
    ends = spark.createDataFrame([(n.number, q) for level in levels for n in level for q in n.ends], "node int, query_id string")
    if ends_count(levels) <= SENT_EDGES:
        ends = F.broadcast(ends)
    picked = [f"p{L}" for L in range(1, most + 1)]
    return now.join(ends, "node").select("query_id", "record_id", F.concat_ws(",", F.array_remove(F.array(*picked), 0)).alias("positions"))
