"""Queries of the engine by group, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldlattice.queries import attributes, building, enumeration, files, hits, motifs, statistics, texts

GROUPS = (motifs, building, enumeration, hits, attributes, statistics, texts, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in GROUPS for name, f in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
