"""Motif corpora: skeletons with every typing, written as complete motif queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlattice.operators.lattice import GRID_POINTS, Points, around, canonical, compact, grid_of, handedness, joined, labelings, points_of, skeletons, typings, with_grid
from foldlattice.operators.search import code_at
from foldlattice.plans.extension import contacts_only
from foldlattice.plans.motif import Motif, Requirement, parse_motif, write_motif

#: Least lengths of strands and helices and the greatest of both, as written by default (fixed values).
LEAST_LENGTH, MOST_LENGTH = {"E": 5, "H": 8}, 1000
#: By grid, in reference places: triples whose handedness is asked, and those asked only of three helices
#: beside two strands; contacts asked, of which one asked, and left free (fixed values).
HANDED = {
    "d": (),
    "e": ((1, 4, 5), (2, 3, 5)),
    "gh": ((1, 2, 4), (1, 2, 5), (1, 3, 4), (1, 3, 5), (2, 3, 4), (2, 3, 5)),
    "f": ((1, 2, 4), (1, 2, 5), (1, 3, 4), (1, 3, 5), (2, 3, 4), (2, 3, 5), (2, 4, 5)),
}
HANDED_IF = {"f": ("HHHEE", ((1, 4, 5), (3, 4, 5)))}
CONTACTS = {"d": ((1, 2), (2, 3), (3, 4), (4, 5)), "e": ((1, 2), (2, 3), (3, 4)), "f": ((1, 2), (2, 3), (3, 4), (4, 5), (1, 5)), "gh": ((1, 2), (2, 3), (2, 4), (2, 5))}
ONE_OF = {"e": ((2, 5), (3, 5))}


def _sheets(points: Points, types: str) -> list[list[int]]:
    """Strands joined by touching, from 1, each group in order."""
    left, out = [i for i, t in enumerate(types) if t == "E"], []
    while left:
        own, queue = set(), [left[0]]
        while queue:
            own.add(i := queue.pop())
            queue += [j for j in left if j not in own and points[j] in around(points[i])]
        left = [i for i in left if i not in own]
        out.append([i + 1 for i in sorted(own)])
    return out


def _contact(a: str, b: str, alike: bool) -> str:
    return ("ct" if a == b == "E" else "uv" if a == b else "CT")[not alike]


def typed_motif(motif_id: str, points: Points, types: str, asked: dict[tuple[int, int], bool] | None = None, triples: list[tuple[int, int, int]] | None = None) -> Motif:
    """A skeleton with types as a motif: codes, sheets, lengths and handedness.

    Touching pairs are c or t between strands, u or v between helices, C or T otherwise, as their places
    are both odd or even or not; strands of one sheet that don't touch are '-', other pairs free.
    ``asked`` tells which pairs keep their contact and which are free, ``triples`` whose sense counts.
    """
    sheets = _sheets(points, types)
    sheet = {i: k for k, own in enumerate(sheets) for i in own}
    codes = {}
    for i, j in combinations(range(1, len(points) + 1), 2):
        near = points[j - 1] in around(points[i - 1]) if asked is None else asked.get((i, j))
        if near:
            codes[i, j] = _contact(types[i - 1], types[j - 1], (j - i) % 2 == 0)
        else:
            codes[i, j] = "-" if i in sheet and j in sheet and sheet[i] == sheet[j] and (asked is None or near is None) else "X"
    needs = [Requirement("sheetS", tuple(own)) for own in sheets if len(own) > 1]
    needs += [Requirement("sheetD", pair) for pair in combinations(sorted(sheet), 2) if sheet[pair[0]] != sheet[pair[1]]]
    needs += [Requirement("length", (i,), LEAST_LENGTH[t], MOST_LENGTH) for i, t in enumerate(types, 1)]
    senses = dict(zip(combinations(range(1, len(points) + 1), 3), handedness(points)))
    hands = tuple((*t, "R" if senses[t] > 0 else "L") for t in (senses if triples is None else triples) if senses[t])
    return Motif(motif_id, tuple(types), codes, hands, tuple(needs))


def runs(points: Points) -> list[list[int]]:
    """Straight runs of three or more touching points."""
    at, out = {p: i for i, p in enumerate(points)}, []
    for a, b in ((1, 0), (0, 1), (-1, 1)):
        for q, r in points:
            if (q - a, r - b) not in at:
                run = []
                while (q, r) in at:
                    run.append(at[q, r])
                    q, r = q + a, r + b
                if len(run) > 2:
                    out.append(run)
    return out


def typing_fits(points: Points, types: str) -> bool:
    """Three in a straight run are of one type, more are strands."""
    return all({types[i] for i in run} == {"E"} or len(run) == 3 and {types[i] for i in run} == {"H"} for run in runs(points))


def _placed(points: Points, grid: str) -> tuple[int, ...]:
    """How a skeleton lies on its grid: of the orders of places the first that leaves the most asked triples with a sense."""
    flat = {t for t, sense in zip(combinations(range(5), 3), handedness(points)) if not sense}
    orders = labelings(points, grid)
    blank = [sum({order.index(x) for x in asked} in map(set, flat) for asked in HANDED[grid]) for order in orders]
    return orders[blank.index(min(blank))]


def minimal_motifs(motif_id: str, points: Points, types: str) -> Iterator[Motif]:
    """Motifs of a five-point skeleton on its grid with the fewest contacts and senses that tell grids apart.

    A grid with two contacts of which one must hold gives two motifs, with '-0' and '-1' behind the id.
    """
    grid = grid_of(points)
    if grid is None:
        return
    own = {ref: i for i, ref in enumerate(_placed(points, grid), 1)}
    pair = lambda p: tuple(sorted(own[x] for x in p))
    triples = list(HANDED[grid])
    if grid in HANDED_IF and "".join(types[own[ref] - 1] for ref in range(1, 6)) == HANDED_IF[grid][0]:
        triples += HANDED_IF[grid][1]
    held = GRID_POINTS[grid]
    asked = {pair((a, b)): False for a, b in combinations(range(1, 6), 2) if held[b - 1] in around(held[a - 1])} | {pair(p): True for p in CONTACTS[grid]}
    choices = [pair(p) for p in ONE_OF.get(grid, ())]
    for k in range(max(1, len(choices))):
        yield typed_motif(f"{motif_id}-{k}" if choices else motif_id, points, types, asked | {p: p == choices[k] for p in choices}, sorted(tuple(sorted(own[x] for x in t)) for t in triples))


def _written(cells: DataFrame, make: Callable[[str, Points, str], Iterator[Motif]]) -> DataFrame:
    """``query_id, nth, ty, types, text`` of the motifs that ``make`` gives for each cell (nth, frame, ty, types)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for nth, frame, ty, types in zip(*(batch.column(c).to_pylist() for c in ("nth", "frame", "ty", "types"))):
                rows += [(m.motif_id, nth, ty, types, write_motif(m)) for m in make(f"s{len(types)}-{nth:04d}-{ty:04d}", points_of(frame), types)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["query_id", "nth", "ty", "types", "text"])

    return cells.select("nth", "frame", "ty", "types").mapInArrow(work, "query_id string, nth long, ty int, types string, text string")


def corpus(spark: SparkSession, n: int) -> DataFrame:
    """``query_id, nth, ty, types, text``: every skeleton of n points with every typing."""
    return _written(skeletons(spark, n).crossJoin(typings(spark, n)), lambda name, points, types: iter([typed_motif(name, points, types)]))


def fitting_corpus(spark: SparkSession, n: int) -> DataFrame:
    """The corpus without typings that straight runs forbid."""
    return _written(skeletons(spark, n).crossJoin(typings(spark, n)), lambda name, points, types: iter([typed_motif(name, points, types)] if typing_fits(points, types) else []))


def minimal_corpus(spark: SparkSession) -> DataFrame:
    """Five-point motifs on known grids with fitting typings, fewest contacts and fewest senses."""
    cells = with_grid(skeletons(spark, 5)).where("grid IS NOT NULL").crossJoin(typings(spark, 5))
    return _written(cells, lambda name, points, types: minimal_motifs(name, points, types) if typing_fits(points, types) else iter(()))


def motifs(found: DataFrame) -> list[Motif]:
    """The motifs of a corpus; it is as small as an enumeration, and searches take it as a list."""
    return [parse_motif(r["query_id"], r["text"]) for r in found.select("query_id", "text").orderBy("query_id").collect()]


_MADE: dict[int, list[Motif]] = {}


def corpus_motifs(spark: SparkSession, n: int) -> list[Motif]:
    """The motifs of ``corpus``, which depend on n alone and so are made once a process."""
    if n not in _MADE:
        _MADE[n] = motifs(corpus(spark, n))
    return _MADE[n]


def motif_named(found: DataFrame, query_id: str) -> Motif:
    """One motif of a corpus by its id."""
    row = found.where(found["query_id"] == query_id).select("text").first()
    if row is None:
        raise KeyError(query_id)
    return parse_motif(query_id, row["text"])


def one_larger(seed: Points, types: str, name: str) -> list[Motif]:
    """Contact-only motifs that add one element to a typed skeleton: compact, every pair of the seed's as it was and its sheets whole."""
    base = contacts_only(typed_motif("seed", seed, types))
    out, seen = [], set()
    for c in joined(seed, ((0, 0),)):
        if not compact(c):
            continue
        at = tuple(range(len(seed))) if c[: len(seed)] == seed else tuple(range(1, len(seed) + 1))
        for new in "HE":
            own = types + new if at[0] == 0 else new + types
            if (canonical(c), own) in seen:
                continue
            m = contacts_only(typed_motif(f"{name}-{len(out):03d}", c, own))
            place = {i: p + 1 for i, p in enumerate(at, 1)}
            sheets = [set(r.elements) for r in m.requirements if r.kind == "sheetS"]
            whole = all(any({place[i] for i in r.elements} <= s for s in sheets) for r in base.requirements if r.kind == "sheetS")
            if whole and all(m.codes[place[i], place[j]] == x for (i, j), x in base.codes.items()):
                seen.add((canonical(c), own))
                out.append(m)
    return out


def bonds_asked(motif: Motif) -> list[int]:
    """How many bonded neighbours a motif asks each of its strands for, most first."""
    bonded = [i for pair, c in motif.codes.items() if c in "ct" for i in pair]
    return sorted((bonded.count(i) for i in set(bonded)), reverse=True)


def bonds_held(records: DataFrame) -> DataFrame:
    """``record_id, held``: bonded neighbours of each strand that has any, most first."""
    # own row by length, the rows before place by place; most records have no bond at all
    later = "length(get(t.rows, x - 1)) - length(translate(get(t.rows, x - 1), 'ct', ''))"
    degree = f"transform(sequence(1, size(t.rows)), x -> {later} + size(filter(slice(t.rows, 1, x - 1), (r, y) -> substring(r, x - y, 1) IN ('c', 't'))))"
    held = f"CASE WHEN exists(t.rows, r -> r RLIKE '[ct]') THEN filter({degree}, d -> d > 0) ELSE cast(array() as array<int>) END"
    held = f"element_at(transform(array(named_struct('rows', rows)), t -> {held}), 1)"
    return records.select("record_id", F.expr(f"CASE WHEN size(rows) > 0 THEN sort_array({held}, false) ELSE cast(array() as array<int>) END").alias("held"))


def room_for(records: DataFrame, motifs: list[Motif]) -> DataFrame:
    """``query_id, crowded, records``: records with enough bonded strands for each motif, place by place of both lists.

    Necessary for a hit.  Motifs and records meet by their distinct lists, of which there are few, and
    never each with each.
    """
    spark = records.sparkSession
    table = spark.createDataFrame([(m.motif_id, crowded(m), bonds_asked(m)) for m in motifs], "query_id string, crowded boolean, asked array<int>")
    kinds = bonds_held(records).groupBy("held").agg(F.count("*").alias("records"))
    # a list of asked bonds is met by those whose i-th largest is no less than its own, for every i
    asked = table.select("asked").distinct()
    places = asked.select("asked", F.posexplode_outer("asked").alias("place", "least"))
    met = places.join(kinds.select("held", "records", F.posexplode("held").alias("place", "has")), "place").where("has >= least").groupBy("asked", "held").agg(F.first("records").alias("records"), F.count("*").alias("places"))
    able = met.where(F.col("places") == F.size("asked")).groupBy("asked").agg(F.sum("records").alias("records"))
    everything = records.agg(F.count("*").alias("everything"))  # of ids alone, without their bonds again
    out = table.join(able, "asked", "left").join(F.broadcast(everything))
    return out.select("query_id", "crowded", F.when(F.size("asked") == 0, F.coalesce("everything", F.lit(0))).otherwise(F.coalesce("records", F.lit(0))).cast("long").alias("records"))


def crowded(motif: Motif) -> bool:
    """Whether a motif asks one strand of a sheet for three or more bonded neighbours, which strands hardly have."""
    bonded = [i for pair, c in motif.codes.items() if c in "ct" for i in pair]
    held = {i for r in motif.requirements if r.kind == "sheetS" for i in r.elements}
    return any(bonded.count(i) > 2 for i in held)
