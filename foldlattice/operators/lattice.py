"""Compact motif topologies on the hexagonal lattice, grown level by level.

A skeleton is an ordered list of lattice points.  Level n joins the skeletons of all splits p + q = n;
each pair's candidates are made in tasks, checked for compactness, and equal topologies (up to
translation and rotation by 60 degrees) fall together by a canonical key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Point = tuple[int, int]
Points = tuple[Point, ...]

#: Unit steps in axial coordinates, in turning order (fixed values).
TURNS = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
#: Allowed contact graphs by size: sorted degrees and number of triangles (fixed values).
GRIDS = {
    3: {((1, 1, 2), 0), ((2, 2, 2), 1)},
    4: {((1, 1, 2, 2), 0), ((1, 2, 2, 3), 1), ((2, 2, 3, 3), 2)},
    5: {((1, 1, 2, 2, 2), 0), ((1, 1, 2, 3, 3), 1), ((2, 2, 2, 2, 4), 2), ((2, 2, 3, 3, 4), 3)},
}


def turned(p: Point, times: int) -> Point:
    for _ in range(times % 6):
        p = (-p[1], p[0] + p[1])
    return p


def around(p: Point) -> list[Point]:
    return [(p[0] + a, p[1] + b) for a, b in TURNS]


def touching(p: Point, held) -> list[Point]:
    return [x for x in around(p) if x in held]


def attaches(p: Point, held) -> bool:
    """Whether a point touches two held ones, or continues the line of the only one."""
    near = touching(p, held)
    return len(near) >= 2 or len(near) == 1 and (2 * near[0][0] - p[0], 2 * near[0][1] - p[1]) in held


def compact(points: Points) -> bool:
    """No outer point has more than three held neighbours, each point attaches to those before it, and the contact graph is allowed."""
    held = set(points)
    outer = {x for p in points for x in around(p)} - held
    if any(len(touching(x, held)) > 3 for x in outer):
        return False
    if not all(attaches(p, set(points[:i])) for i, p in enumerate(points) if i >= 2):
        return False
    allowed = GRIDS.get(len(points))
    if allowed is None:
        return True
    edges = {frozenset((p, x)) for p in points for x in touching(p, held)}
    degrees = Counter(p for e in edges for p in e)
    triangles = sum(all(frozenset(pair) in edges for pair in combinations(t, 2)) for t in combinations(points, 3))
    return (tuple(sorted(degrees[p] for p in points)), triangles) in allowed


def canonical(points: Points) -> Points:
    """The least of six rotations with the first point at the origin."""
    q, r = points[0]
    moved = [(a - q, b - r) for a, b in points]
    return min(tuple(turned(p, k) for p in moved) for k in range(6))


def joined(first: Points, second: Points) -> Iterator[Points]:
    """Both orders of ``first`` with every placement of ``second`` whose some point attaches to it.

    Places come in the order of first's points and of the steps around each, turns in turning order.
    """
    held = set(first)
    for place in dict.fromkeys(x for p in first for x in around(p) if x not in held and attaches(x, held)):
        for hinge in second if len(second) > 1 else second[:1]:
            for k in range(6 if len(second) > 1 else 1):
                laid = tuple((a + place[0], b + place[1]) for a, b in (turned((p[0] - hinge[0], p[1] - hinge[1]), k) for p in second))
                if held.isdisjoint(laid):
                    yield first + laid
                    yield laid + first


def text_of(points: Points) -> str:
    return ";".join(f"{q},{r}" for q, r in points)


def points_of(text: str) -> Points:
    return tuple((int(q), int(r)) for q, r in (p.split(",") for p in text.split(";")))


def skeletons(spark: SparkSession, n: int) -> DataFrame:
    """``nth, points, frame`` of all compact skeletons of n points, each once.

    ``points`` ('q,r;q,r;...') is the canonical form, ``frame`` the same skeleton where it was first found:
    by splits with fewer points on the smaller side first, then by both sides' numbers and the order of
    ``joined``; ``nth`` numbers skeletons in that order.
    """
    if n <= 2:
        own = text_of(((0, 0), (1, 0))[:n])
        return spark.createDataFrame([(0, own, own)], "nth long, points string, frame string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for split, a, x, b, y in zip(*(batch.column(k).to_pylist() for k in range(5))):
                found: dict[Points, tuple[int, Points]] = {}
                for at, c in enumerate(joined(points_of(x), points_of(y))):
                    if compact(c):
                        found.setdefault(canonical(c), (at, c))
                rows += [(text_of(c), text_of(own), split, a, b, at) for c, (at, own) in found.items()]
            types = [pa.string()] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["points", "frame", "split", "a", "b", "at"])

    out = None
    for q in range(1, n // 2 + 1):
        larger = skeletons(spark, n - q).select(F.lit(q).cast("long").alias("split"), F.col("nth").alias("a"), F.col("frame").alias("x"))
        made = larger.crossJoin(skeletons(spark, q).select(F.col("nth").alias("b"), F.col("frame").alias("y"))).mapInArrow(work, "points string, frame string, split long, a long, b long, at long")  # the levels are small tables
        out = made if out is None else out.unionByName(made)
    order = F.struct("split", "a", "b", "at")
    once = out.groupBy("points").agg(F.min_by("frame", order).alias("frame"), F.min(order).alias("found"))
    return once.select((F.row_number().over(W.orderBy("found")) - 1).cast("long").alias("nth"), "points", "frame")


def handedness(points: Points) -> tuple[int, ...]:
    """Sign of the triple product of each triple of points whose directions alternate up and down."""
    vectors = [(q + r / 2, r * math.sqrt(3) / 2, 1.0 if i % 2 == 0 else -1.0) for i, (q, r) in enumerate(points)]

    def sense(a, b, c) -> int:
        t = (a[1] * b[2] - a[2] * b[1]) * c[0] + (a[2] * b[0] - a[0] * b[2]) * c[1] + (a[0] * b[1] - a[1] * b[0]) * c[2]
        return 0 if abs(t) < 1e-9 else 1 if t > 0 else -1

    return tuple(sense(*t) for t in combinations(vectors, 3))


def handedness_classes(found: DataFrame) -> DataFrame:
    """``signature, nth, points, members``: one skeleton for each handedness signature.

    The one of least pairwise distance sum stays, then of fewest rows of points, then the first found.
    Signatures depend on where a skeleton lies, which is where it was first found.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [points_of(p) for p in batch.column(2).to_pylist()]
            flat = [[(q + r / 2, r * math.sqrt(3) / 2) for q, r in p] for p in own]
            spread = [round(sum(math.dist(a, b) for a, b in combinations(p, 2)), 6) for p in flat]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([",".join(map(str, handedness(p))) for p in own]), pa.array(spread), pa.array([len({r for _, r in p}) for p in own])], ["nth", "points", "signature", "spread", "layers"])

    marked = found.select("nth", "points", "frame").mapInArrow(work, "nth long, points string, signature string, spread double, layers long")
    order = F.struct("spread", "layers", "nth")
    return marked.groupBy("signature").agg(F.min_by("nth", order).alias("nth"), F.min_by("points", order).alias("points"), F.count("*").alias("members"))


#: Five-point grids of the narrower compactness test, as axial points in reference order (fixed values).
GRID_POINTS = {
    "d": ((0, 0), (1, 0), (2, 0), (3, 0), (4, 0)),
    "e": ((0, 0), (1, 0), (2, 0), (3, 0), (1, 1)),
    "f": ((0, 0), (1, 0), (2, 0), (1, 1), (0, 1)),
    "gh": ((-1, 0), (0, 0), (1, 0), (0, 1), (0, -1)),
}


def _gaps(points: Points) -> list[int]:
    """Squared distance of each ordered pair of points."""
    return [(a - c) ** 2 + (a - c) * (b - d) + (b - d) ** 2 for (a, b), (c, d) in permutations(points, 2)]


def labelings(points: Points, grid: str) -> list[tuple[int, ...]]:
    """The orders of a grid's places (from 1) whose distances are those of the skeleton's points, pair by pair, ascending."""
    wanted = _gaps(points)
    if sorted(wanted) != sorted(_gaps(GRID_POINTS[grid])):
        return []
    return [order for order in permutations(range(1, len(points) + 1)) if _gaps(tuple(GRID_POINTS[grid][k - 1] for k in order)) == wanted]


def grid_of(points: Points) -> str | None:
    """The grid that a five-point skeleton is congruent to."""
    return next((g for g in GRID_POINTS if len(points) == 5 and labelings(points, g)), None)


def with_grid(found: DataFrame) -> DataFrame:
    """Adds ``grid``; the narrower compactness test keeps skeletons that have one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([grid_of(points_of(p)) for p in batch.column("points").to_pylist()], pa.string())], [*batch.schema.names, "grid"])

    return found.mapInArrow(work, StructType([*found.schema.fields, StructField("grid", StringType())]))


def chiral_triples(found: DataFrame) -> DataFrame:
    """``shape, chirality`` of three-point skeletons: paths plain, left and right, triangles left and right."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = ["".join(str(int(b in around(a))) for a, b in combinations(points_of(p), 2)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.string())], ["shape"])

    sides = F.when(F.col("shape") == "111", F.array(F.lit("L"), F.lit("R"))).otherwise(F.array(F.lit(""), F.lit("L"), F.lit("R")))
    return found.select("points").mapInArrow(work, "shape string").distinct().select("shape", F.explode(sides).alias("chirality"))


def _around_layers(p: tuple[int, ...]) -> list[tuple[int, ...]]:
    return [(a, b, p[2]) for a, b in around(p[:2])] + [(p[0], p[1], z) for z in (p[2] - 1, p[2] + 1) if -1 <= z <= 1]


def declared_skeletons(spark: SparkSession, n: int) -> DataFrame:
    """``points`` ('q,r,z;...') of skeletons over three layers that grow by one declared contact at a time.

    A new point needs one held neighbour; no outer point may have more than three, and the contact graph
    of all points must be allowed.  Skeletons that differ only in declared contacts count once.
    """
    if n <= 2:
        return spark.createDataFrame([(";".join(["0,0,0", "1,0,0"][:n]),)], "points string")

    def fits(points) -> bool:
        held = set(points)
        if any(sum(x in held for x in _around_layers(o)) > 3 for o in {x for p in points for x in _around_layers(p)} - held):
            return False
        edges = {frozenset((p, x)) for p in points for x in _around_layers(p) if x in held}
        degrees = Counter(p for e in edges for p in e)
        triangles = sum(all(frozenset(pair) in edges for pair in combinations(t, 2)) for t in combinations(points, 3))
        return len(points) not in GRIDS or (tuple(sorted(degrees[p] for p in points)), triangles) in GRIDS[len(points)]

    def least(points):
        q, r, _ = points[0]
        return min(tuple((*turned((a - q, b - r), k), z) for a, b, z in points) for k in range(6))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                points = tuple(tuple(map(int, p.split(","))) for p in text.split(";"))
                for x in {x for p in points for x in _around_layers(p)} - set(points):
                    found |= {least(c) for c in ((*points, x), (x, *points)) if fits(c)}
            yield pa.RecordBatch.from_arrays([pa.array([";".join(",".join(map(str, p)) for p in c) for c in sorted(found)], pa.string())], ["points"])

    return declared_skeletons(spark, n - 1).mapInArrow(work, "points string").distinct()


def typings(spark: SparkSession, n: int) -> DataFrame:
    """``ty, types``: all strings of n letters H and E, the first the highest bit and E set."""
    return spark.range(2**n).select(F.col("id").cast("int").alias("ty"), F.translate(F.lpad(F.bin("id"), n, "0"), "01", "HE").alias("types"))
