"""Interaction codes: what a motif's code letter accepts."""

from __future__ import annotations

#: Alphabets (fixed values).
ELEMENT_TYPES = "HEL"
QUERY_TYPES = "HEXL"
RECORD_CODES = "ctuvN-"
QUERY_CODES = "ctuvN-XxCT"


def code_matches(held: str, wanted: str) -> str:
    """SQL condition: code ``held`` of a record satisfies code ``wanted`` of a motif."""
    return f"({wanted} = 'X' OR {held} = {wanted} OR ({wanted} = 'x' AND {held} <> '-') OR ({wanted} = 'T' AND {held} IN ('v', 't')) OR ({wanted} = 'C' AND {held} IN ('u', 'c')))"


def type_matches(held: str, wanted: str) -> str:
    return f"({wanted} = 'X' OR {held} = {wanted})"
