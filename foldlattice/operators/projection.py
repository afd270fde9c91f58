"""Records cut down to one chain each: elements, matrix and sheets renumbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.functions import geometry as G
from foldlattice.operators.search import code_at


def by_chain(records: DataFrame) -> DataFrame:
    """``record_id, chain, n, elements, rows, sheets, places``: one record a chain, in its row and without a shuffle.

    ``places`` are the elements' places in the whole record.  A pair keeps its code, a sheet the elements
    that the chain has of it under their new places; a sheet without any is left out.
    """
    own = records.select("record_id", "elements", "rows", "sheets", F.explode_outer(F.expr("array_distinct(transform(elements, e -> e.chain))")).alias("chain")).where("chain IS NOT NULL")
    own = own.withColumn("places", F.expr("filter(sequence(1, size(elements)), p -> element_at(elements, p).chain = chain)"))
    held = {"rows": "rows", "places": "places", "sheets": "sheets"}
    rows = G.let(held, lambda v: f"transform({v['places']}, (p, i) -> concat('*', array_join(transform(slice({v['places']}, i + 2, size({v['places']})), q -> {code_at(v['rows'], 'p', 'q')}), '')))", True, "t")
    sheets = G.let(held, lambda v: f"filter(transform({v['sheets']}, s -> transform(filter(s, p -> array_contains({v['places']}, p)), p -> cast(array_position({v['places']}, p) as int))), s -> size(s) > 0)", True, "t")
    return own.select("record_id", "chain", F.size("places").alias("n"), F.expr("transform(places, p -> element_at(elements, p))").alias("elements"), F.expr(rows).alias("rows"), F.expr(sheets).alias("sheets"), "places")
