"""Names and their parts, as SQL expressions: query cells, groups, accessions, dates, ranges."""

from __future__ import annotations


def cell_name(sk: str, ty: str) -> str:
    """``s5-0007-0031`` of a skeleton and a typing."""
    return f"concat('s5-', lpad(cast({sk} as string), 4, '0'), '-', lpad(cast({ty} as string), 4, '0'))"


def cell_part(name: str, part: int) -> str:
    """Skeleton (1) or typing (2) of a cell's name; null if it is none."""
    return f"try_cast(nullif(regexp_extract({name}, '^s[0-9]+-([0-9]+)-([0-9]+)$', {part}), '') as int)"


def h_group(t_group: str) -> str:
    """The first two parts of a dotted group name."""
    return f"substring_index({t_group}, '.', 2)"


def accession(record: str) -> str:
    """Accession of ``dpam_ACC_nD3``, ``ACC_D3`` and the like."""
    return f"regexp_replace(regexp_replace({record}, '^dpam_', ''), '_n?D.*$', '')"


def domain_number(record: str) -> str:
    """Domain number behind an accession; null where there is none."""
    return f"try_cast(nullif(regexp_extract({record}, '_n?D([0-9]+)$', 1), '') as int)"


def year_of(date: str) -> str:
    """Year of MM/DD/YY, where 31 to 99 lie in the past century; null for other texts."""
    yy = f"cast(substring(trim({date}), 7, 2) as int)"
    return f"CASE WHEN rlike(trim({date}), '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}') THEN {yy} + CASE WHEN {yy} > 30 THEN 1900 ELSE 2000 END END"


def ranges_of(text: str) -> str:
    """``array<struct<chain, lo, hi>>`` of 'A:5-40,A:60-80' or '5-40'; parts that are no range are left out."""
    part = r"^\s*(?:([A-Za-z0-9]+):)?(-?[0-9]+)-(-?[0-9]+)\s*$"
    own = f"transform(filter(split({text}, ','), x -> rlike(x, r'{part}')), x -> named_struct('chain', regexp_extract(x, r'{part}', 1), 'lo', cast(regexp_extract(x, r'{part}', 2) as bigint), 'hi', cast(regexp_extract(x, r'{part}', 3) as bigint)))"
    return own


def line_angle(angle: str) -> str:
    """Angle of two lines, 0 to 90, from that of two vectors."""
    return f"least({angle}, 180e0 - {angle})"
