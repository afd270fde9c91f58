"""Larger and looser motifs from a given one."""

from __future__ import annotations

from dataclasses import replace

from foldlattice.plans.motif import Motif, Requirement, write_motif

#: Codes that lose their direction when only contacts count (fixed values).
DIRECTED = "uvctCT"


def contacts_only(motif: Motif) -> Motif:
    """The motif with every directed code as any contact and without handedness."""
    return replace(motif, codes={k: "x" if c in DIRECTED else c for k, c in motif.codes.items()}, handedness=())


def _inserted(motif: Motif, slot: int, etype: str, touches: dict[int, str], name: str) -> Motif:
    """One element more at place ``slot``; ``touches`` maps old elements to codes with the new one."""

    def moved(i: int) -> int:
        return i + (i >= slot)

    types = (*motif.types[: slot - 1], etype, *motif.types[slot - 1 :])
    codes = {(moved(i), moved(j)): c for (i, j), c in motif.codes.items()}
    codes |= {tuple(sorted((moved(i), slot))): touches.get(i, "X") for i in range(1, motif.k + 1)}
    hands = tuple((moved(i), moved(j), moved(m), side) for i, j, m, side in motif.handedness)
    needs = tuple(replace(r, elements=tuple(map(moved, r.elements))) for r in motif.requirements)
    return Motif(name, types, codes, hands, needs)


def extended(motif: Motif, lengths: dict[str, int] | None = None) -> list[Motif]:
    """Every one-element extension: a strand beside a strand (c, t) or a helix on a strand (C, T), in each slot, each once.

    ``lengths`` gives the least length of the new element by type.
    """
    lengths = lengths or {"E": 5, "H": 8}
    out: dict[str, Motif] = {}
    for host, held in enumerate(motif.types, 1):
        if held != "E":
            continue
        for etype, kinds in (("E", "ct"), ("H", "CT")):
            for code in kinds:
                for slot in range(1, motif.k + 2):
                    made = _inserted(motif, slot, etype, {host: code}, f"{motif.motif_id}+{etype}{code}{host}@{slot}")
                    made = replace(made, requirements=(*made.requirements, Requirement("length", (slot,), lengths[etype], 1000)))
                    out.setdefault(write_motif(made), made)
    return list(out.values())
