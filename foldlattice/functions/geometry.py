"""Geometry of element axes as SQL expressions that Spark and other SQL engines read alike.

An element's axis runs from ``fx, fy, fz`` to ``lx, ly, lz``; arguments are row aliases.  Degenerate
axes give NULL, and NULL is no contact and no handedness.
"""

from __future__ import annotations

AXES = "xyz"
#: Contact limits in Angstrom, orientation limits in degrees (fixed values).
MIN_OVERLAP, MAX_DISTANCE, ANTIPARALLEL_ABOVE, PARALLEL_BELOW = 2.5, 11.0, 95.0, 85.0


def direction(e: str) -> list[str]:
    return [f"({e}.l{k} - {e}.f{k})" for k in AXES]


def dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v)) + ")"


def cross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


def norm(u: list[str]) -> str:
    return f"sqrt({dot(u, u)})"


def angle_of(u: list[str], v: list[str]) -> str:
    """Degrees between two vectors, 0 to 180."""
    return f"degrees(acos(greatest(-1e0, least(1e0, {dot(u, v)} / nullif({norm(u)} * {norm(v)}, 0e0)))))"


def angle(a: str, b: str) -> str:
    return angle_of(direction(a), direction(b))


def length(a: str) -> str:
    return norm(direction(a))


def let(values: dict[str, str], body, bind: bool, name: str) -> str:
    """``body`` over named expressions: written out, or bound once by a one-element transform.

    Binding is for places where expressions are interpreted, such as lambdas; ``body`` gets a dict of
    what to write for each name.
    """
    if not bind:
        return body(values)
    fields = ", ".join(f"'{k}', {v}" for k, v in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body({k: f'{name}.{k}' for k in values})}), 1)"


def _overlap_along(a: str, b: str, ends: tuple[str, str], bind: bool) -> str:
    """Overlap of both axes' shadows on the line between two midpoints.

    ``ends``: which end of b is paired with a's first and last point.
    """
    midpoints = {f"s{k}": f"(({a}.f{k} + {b}.{ends[0]}{k}) / 2e0)" for k in AXES} | {f"t{k}": f"(({a}.l{k} + {b}.{ends[1]}{k}) / 2e0)" for k in AXES}

    def shadows(m: dict[str, str]) -> str:
        line = {f"d{k}": f"({m[f't{k}']} - {m[f's{k}']})" for k in AXES}
        return let(line, lambda d: let({"n": f"nullif({norm(list(d.values()))}, 0e0)"}, lambda n: on_line(m, list(d.values()), n["n"]), bind, "z"), bind, "y")

    def on_line(m: dict[str, str], line: list[str], size: str) -> str:
        places = {f"{w}{end}": f"({dot([f'({e}.{end}{k} - {m[f's{k}']})' for k in AXES], line)} / {size})" for w, e in (("a", a), ("b", b)) for end in "fl"}
        return let(places, shared, bind, "w")

    def shared(t: dict[str, str]) -> str:
        high = f"least(greatest({t['af']}, {t['al']}), greatest({t['bf']}, {t['bl']}))"
        low = f"greatest(least({t['af']}, {t['al']}), least({t['bf']}, {t['bl']}))"
        return f"greatest(0e0, {high} - {low})"

    return let(midpoints, shadows, bind, "x")


def overlap(a: str, b: str, bind: bool = False) -> str:
    """The larger overlap along the two bisecting axes of a pair."""
    return f"greatest({_overlap_along(a, b, ('f', 'l'), bind)}, {_overlap_along(a, b, ('l', 'f'), bind)})"


def distance(a: str, b: str) -> str:
    """Least distance between first, middle and last points of both axes, at most 1000."""

    def points(e: str) -> list[list[str]]:
        return [[f"{e}.f{k}" for k in AXES], [f"(({e}.f{k} + {e}.l{k}) / 2e0)" for k in AXES], [f"{e}.l{k}" for k in AXES]]

    gaps = [[f"({p} - {q})" for p, q in zip(u, v)] for u in points(a) for v in points(b)]
    return f"least(1000e0, sqrt(least({', '.join(dot(g, g) for g in gaps)})))"


def interaction_code(overlap_: str, distance_: str, angle_: str, both_strands: str, bonded: str, same_sheet: str) -> str:
    """Code of a pair from its measures; a bonded pair is t (antiparallel) or c (parallel) by its angle."""
    bond = f"CASE WHEN {angle_} < 90e0 THEN 'c' ELSE 't' END"
    turn = f"CASE WHEN {angle_} > {ANTIPARALLEL_ABOVE}e0 THEN 'v' WHEN {angle_} < {PARALLEL_BELOW}e0 THEN 'u' ELSE 'N' END"
    return f"CASE WHEN {bonded} THEN {bond} WHEN {distance_} <= {MAX_DISTANCE}e0 AND {overlap_} > {MIN_OVERLAP}e0 THEN CASE WHEN {both_strands} AND {same_sheet} THEN '-' ELSE {turn} END ELSE '-' END"


def chirality(a: str, b: str, c: str) -> str:
    """R, L or blank: the sense in which three axes, turned to a's side, follow one another."""
    base = direction(a)

    def turned(e: str) -> list[str]:
        own = direction(e)
        return [f"(CASE WHEN {dot(base, own)} < 0e0 THEN -1e0 ELSE 1e0 END * {k})" for k in own]

    mean = [f"({x} + {y} + {z})" for x, y, z in zip(base, turned(b), turned(c))]

    def middle(e: str, k: str) -> str:
        return f"(({e}.f{k} + {e}.l{k}) / 2e0)"

    m2, m3 = ([f"({middle(e, k)} - {middle(a, k)})" for k in AXES] for e in (b, c))
    sense = angle_of(mean, cross(m2, m3))
    return f"CASE WHEN {sense} < 90e0 THEN 'R' WHEN {sense} > 90.001e0 THEN 'L' ELSE '' END"
