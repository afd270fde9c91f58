"""Motif queries: their text form, checks, and the SQL that states them relationally."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from foldlattice.functions.codes import QUERY_CODES, QUERY_TYPES, code_matches, type_matches


class MotifError(ValueError):
    """A motif text that doesn't follow its grammar."""


@dataclass(frozen=True)
class Requirement:
    """kind: length, sheetS, sheetD, chainS, chainD, chainAll, parallel or antiparallel; elements from 1."""

    kind: str
    elements: tuple[int, ...] = ()
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class Motif:
    """``codes[i, j]`` (1-based, i < j) and constraints of a k-element motif."""

    motif_id: str
    types: tuple[str, ...]
    codes: dict[tuple[int, int], str]
    handedness: tuple[tuple[int, int, int, str], ...] = ()
    requirements: tuple[Requirement, ...] = field(default=())

    @property
    def k(self) -> int:
        return len(self.types)

    @property
    def one_chain(self) -> bool:
        """Every element in the first one's chain, unless a chain directive lifts that."""
        return not any(r.kind in ("chainD", "chainAll") for r in self.requirements)

    def lengths(self, i: int) -> list[tuple[int, int]]:
        return [(r.low, r.high) for r in self.requirements if r.kind == "length" and r.elements == (i,)]

    def upper_codes(self) -> list[str]:
        """Codes by the later element: (1,2), (1,3), (2,3), (1,4) ..."""
        return [self.codes[i, j] for j in range(2, self.k + 1) for i in range(1, j)]


def parse_motif(motif_id: str, text: str) -> Motif:
    """A motif from its lines: numbers, types, matrix rows, constraint lines.

    ``sheet S`` and ``chain S`` are read like ``sheetS`` and ``chainS``; a length without an upper
    bound has none.  Anything malformed raises ``MotifError``.
    """
    lines = [x.rstrip() for x in text.splitlines() if x.strip()]
    if len(lines) < 2 or not lines[0].strip().startswith("1"):
        raise MotifError(f"{motif_id}: the first line numbers the elements from 1")
    types = tuple(lines[1].split())
    k = len(types)
    if k < 2 or any(t not in QUERY_TYPES or len(t) != 1 for t in types):
        raise MotifError(f"{motif_id}: types are letters of {QUERY_TYPES}, at least two")
    if len(lines) < 2 + k:
        raise MotifError(f"{motif_id}: {k} matrix rows are needed")
    codes = {}
    for i in range(1, k + 1):
        row = "".join(lines[1 + i].split())
        if len(row) != k - i + 1 or row[0] != "*" or any(c not in QUERY_CODES for c in row[1:]):
            raise MotifError(f"{motif_id}: row {i} is '*' and {k - i} codes of {QUERY_CODES}")
        codes |= {(i, i + d): row[d] for d in range(1, len(row))}
    hands, needs = [], []
    for line in lines[2 + k :]:
        words = re.sub(r"^(sheet|chain) (S|D|All)\b", r"\1\2", line.strip()).split()
        kind, rest = words[0], words[1:]
        try:
            if kind == "handedness":
                i, j, m = map(int, rest[:3])
                if len(rest) != 4 or rest[3] not in "RL":
                    raise ValueError
                hands.append((i, j, m, rest[3]))
                ids = (i, j, m)
            elif kind == "length":
                ids = (int(rest[0]),)
                needs.append(Requirement(kind, ids, int(rest[2]), int(rest[3]) if len(rest) > 3 else 1 << 30))
            elif kind in ("sheetS", "sheetD", "chainS", "chainD", "parallel", "antiparallel"):
                ids = tuple(map(int, rest))
                if len(ids) < 2 or kind.endswith("parallel") and len(ids) != 2:
                    raise ValueError
                needs.append(Requirement(kind, ids))
            elif kind == "chainAll":
                ids = ()
                needs.append(Requirement(kind))
            else:
                raise ValueError
        except (ValueError, IndexError):
            raise MotifError(f"{motif_id}: can't read {line.strip()!r}") from None
        if any(not 1 <= i <= k for i in ids):
            raise MotifError(f"{motif_id}: {line.strip()!r} names an element beyond {k}")
    return Motif(motif_id, types, codes, tuple(hands), tuple(needs))


def write_motif(motif: Motif) -> str:
    """The text form of a motif; ``parse_motif`` reads it back."""
    k = motif.k
    out = [" ".join(map(str, range(1, k + 1))), " ".join(motif.types)]
    out += [" " * 2 * (i - 1) + " ".join(["*", *(motif.codes[i, j] for j in range(i + 1, k + 1))]) for i in range(1, k + 1)]
    for r in motif.requirements:
        out.append(f"length {r.elements[0]} {motif.types[r.elements[0] - 1]} {r.low} {r.high}" if r.kind == "length" else " ".join([r.kind, *map(str, r.elements)]))
    out += [f"handedness {i} {j} {m} {side}" for i, j, m, side in motif.handedness]
    return "\n".join(out) + "\n"


def motif_sql(motif: Motif, elements: str, contacts: str, sheets: str | None = None, chirality=None) -> str:
    """The motif as a k-way self join, for engines that only read SQL.

    ``elements`` (record_id, pos, etype, chain, length), ``contacts`` (record_id, i, j, code) and
    ``sheets`` (record_id, sheet, pos) are relations; ``chirality(a, b, c)`` gives an expression.
    """
    k = motif.k
    joins, where = [f"{elements} e1"], [type_matches("e1.etype", f"'{motif.types[0]}'")]
    for j in range(2, k + 1):
        on = [f"e{j}.record_id = e1.record_id", f"e{j}.pos > e{j - 1}.pos"]
        if motif.one_chain:
            on.append(f"e{j}.chain = e1.chain")
        joins.append(f"JOIN {elements} e{j} ON {' AND '.join(on)}")
        where.append(type_matches(f"e{j}.etype", f"'{motif.types[j - 1]}'"))
    for (i, j), c in motif.codes.items():
        if c != "X":
            joins.append(f"JOIN {contacts} c{i}_{j} ON c{i}_{j}.record_id = e1.record_id AND c{i}_{j}.i = e{i}.pos AND c{i}_{j}.j = e{j}.pos AND {code_matches(f'c{i}_{j}.code', repr(c))}")
    for r in motif.requirements:
        own = [f"e{i}" for i in r.elements]
        if r.kind == "length":
            where.append(f"{own[0]}.length BETWEEN {r.low} AND {r.high}")
        elif r.kind == "chainS":
            where += [f"{e}.chain = {own[0]}.chain" for e in own[1:]]
        elif r.kind == "chainD":
            where.append("(" + " OR ".join(f"{e}.chain <> {own[0]}.chain" for e in own[1:]) + ")")
        elif r.kind in ("sheetS", "sheetD"):
            places = ", ".join(f"{e}.pos" for e in own)
            same = f"(NOT EXISTS (SELECT 1 FROM {sheets} s WHERE s.record_id = e1.record_id) OR EXISTS (SELECT 1 FROM {sheets} s WHERE s.record_id = e1.record_id AND s.pos IN ({places}) GROUP BY s.sheet HAVING count(*) = {len(own)}))"
            where.append(same if r.kind == "sheetS" else f"NOT {same}")
    for i, j, m, side in motif.handedness:
        where.append(f"{chirality(f'e{i}', f'e{j}', f'e{m}')} = '{side}'")
    picked = " || ',' || ".join(f"CAST(e{j}.pos AS VARCHAR)" for j in range(1, k + 1))
    order = ", ".join(f"e{j}.pos DESC" for j in range(1, k + 1))
    return f"SELECT '{motif.motif_id}' AS query_id, e1.record_id, CAST(row_number() OVER (PARTITION BY e1.record_id ORDER BY {order}) AS INTEGER) AS motif_idx, {picked} AS positions FROM {' '.join(joins)} WHERE {' AND '.join(where)}"
