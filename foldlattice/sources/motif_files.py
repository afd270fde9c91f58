"""Motifs from files: single texts, manifests of paths, listings of enumerated motifs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from foldlattice.plans.motif import Motif, MotifError, Requirement, parse_motif


def _text(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:  # no such path
        return None
    return row[0] if row else ""


def read_motifs(spark: SparkSession, path: str) -> list[Motif]:
    """The motif of a file, or those of all paths in it if its first line names a file.

    A motif is named after its file; a path that can't be read raises ``MotifError``.
    """
    text = _text(spark, path)
    if text is None:
        raise MotifError(f"{path}: can't be read")
    paths = [x.strip() for x in text.splitlines() if x.strip()]
    if paths and not re.match(r"1(\s|$)", paths[0]) and _text(spark, paths[0]) is not None:
        found = [(p, _text(spark, p)) for p in paths]
        gone = [p for p, t in found if t is None]
        if gone:
            raise MotifError(f"{path}: can't read {', '.join(gone)}")
    else:
        found = [(path, text)]
    return [parse_motif(p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".query"), t) for p, t in found]


def listed_motifs(text: str) -> Iterator[Motif]:
    """Motifs of a listing: an outer ``[size-skeleton-third]`` and an inner ``[first-second]`` head, numbers, types, matrix rows, then sS, sD and hand lines.

    Malformed entries are left out.  Ids are ``size-skeleton-third-first-second``.
    """
    parts = re.split(r"(?m)^\s*\[(\d+)-(\d+)-(\d+)\]\s*$", text)
    for size, skeleton, third, body in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4]):
        lines = [x.split() for x in body.strip().splitlines()]
        lines = lines[: lines.index([])] if [] in lines[1:] else lines
        k = int(size)
        head = re.fullmatch(r"\[(\d+)-(\d+)\]", " ".join(lines[0])) if lines else None
        if head is None or len(lines) < 3 + k or lines[1] != [str(i) for i in range(1, k + 1)] or len(lines[2]) != k:
            continue
        rows = lines[3 : 3 + k]
        if any(len(row) != k - i for i, row in enumerate(rows)):
            continue
        codes = {(i, i + d): row[d] for i, row in enumerate(rows, 1) for d in range(1, len(row))}
        rest = lines[3 + k :]
        needs = [Requirement({"sS": "sheetS", "sD": "sheetD"}[x[0]], tuple(map(int, x[1:]))) for x in rest if x[0] in ("sS", "sD")]
        hands = tuple((int(x[1]), int(x[2]), int(x[3]), x[4]) for x in rest if x[0] == "hand" and len(x) == 5)
        yield Motif(f"{size}-{skeleton}-{third}-{head[1]}-{head[2]}", tuple(lines[2]), codes, hands, tuple(needs))


def listed_motif(text: str, name: str) -> Motif:
    """The first motif of a listing whose id begins with ``size-skeleton-third-first``."""
    for m in listed_motifs(text):
        if m.motif_id == name or m.motif_id.startswith(f"{name}-"):
            return m
    raise KeyError(name)
