"""Adjacency signatures of small connected element subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.operators.search import code_at


def connected_signatures(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``record_id, i, j, m, sig, keep``: contact bits (i,j)(i,m)(j,m) of each connected element triple; no shuffle."""
    one = records.select("record_id", "n", "rows", *keep, F.explode(F.expr("sequence(1, n)")).alias("i")).where("i <= n - 2")
    two = one.select("*", F.explode(F.expr("sequence(i + 1, n - 1)")).alias("j"))
    three = two.select("*", F.explode(F.expr("sequence(j + 1, n)")).alias("m"))
    bits = [f"CASE WHEN {code_at('rows', a, b)} <> '-' THEN 1 ELSE 0 END" for a, b in (("i", "j"), ("i", "m"), ("j", "m"))]
    return three.where(" + ".join(f"({b})" for b in bits) + " >= 2").select("record_id", "i", "j", "m", F.expr(f"concat({', '.join(bits)})").alias("sig"), *keep)


def connected_subsets(records: DataFrame, k: int, fits: str = "true", codes: str = "ctuvN", keep: tuple[str, ...] = (), alive: str | None = None) -> DataFrame:
    """``record_id, keep, rows, places``: each connected subset of k elements once, its places ascending.

    Elements ``p`` for which ``fits`` holds are nodes, pairs with one of ``codes`` are edges.  A subset grows
    from its first element: the next one comes from the open neighbours, whose own neighbours
    join them only where they lie behind the first element and touch nothing taken or skipped before,
    so every subset arises in one way and none that isn't connected arises.  ``alive`` is a condition on the
    array ``taken`` that a subset and all that it grew from must meet.  No shuffle, no limit on a record's size.
    """
    own = records.select("record_id", "rows", *keep, F.expr(f"filter(sequence(1, n), p -> {fits})").alias("fit"))
    both = code_at("t.rows", "least(i, j)", "greatest(i, j)")
    near = f"element_at(transform(array(named_struct('rows', rows, 'fit', fit)), t -> transform(sequence(1, array_max(fit)), i -> CASE WHEN array_contains(t.fit, i) THEN filter(t.fit, j -> j <> i AND instr('{codes}', {both}) > 0) ELSE cast(array() as array<int>) END)), 1)"
    own = own.withColumn("near", F.expr(near))
    # ``open``: may be taken next; ``closed``: taken or next to what is taken
    # no filter on the size of ``fit``: it would go below what makes the elements, and each place make them again
    now = own.select("*", F.explode_outer(F.expr(f"CASE WHEN size(fit) >= {k} THEN fit END")).alias("v")).where("v IS NOT NULL").drop("fit")
    now = now.withColumn("taken", F.array("v")).withColumn("closed", F.expr("concat(array(v), element_at(near, v))")).withColumn("open", F.expr("filter(element_at(near, v), j -> j > v)"))
    for level in range(2, k + 1):
        if alive and level > 2:
            now = now.where(alive)
        now = now.select("*", F.posexplode_outer("open").alias("at", "w")).where("w IS NOT NULL")
        grown = {"open": F.expr("concat(slice(open, at + 2, size(open)), filter(array_except(element_at(near, w), closed), j -> j > v))"), "closed": F.expr("array_union(closed, element_at(near, w))")} if level < k else {}
        now = now.withColumns({"taken": F.expr("concat(taken, array(w))"), **grown}).drop("at", "w")
    if alive:
        now = now.where(alive)
    return now.select("record_id", "rows", *keep, F.sort_array("taken").alias("places"))


def two_sheet_signatures(records: DataFrame, least: dict[str, int] | None = None, any_sheets: bool = False) -> DataFrame:
    """``record_id, positions, partition, contacts`` of connected five-element subsets over exactly two sheets, or over any.

    Elements count from their type's ``least`` length on (helices 8, strands 5).  ``partition`` names each
    element's sheet by first appearance, elements of no sheet together; ``contacts`` are the ten contact
    bits.  Subsets of more than two sheets stop growing.
    """
    least = least or {"H": 8, "E": 5}
    fits = " OR ".join(f"(element_at(elements, p).etype = '{t}' AND element_at(elements, p).length >= {n})" for t, n in least.items())
    of_sheet = "transform(sequence(1, n), p -> aggregate(sequence(0, size(sheets)), 0, (a, s) -> CASE WHEN s > 0 AND array_contains(element_at(sheets, s), p) THEN s ELSE a END))"
    held = "size(array_remove(array_distinct(transform(taken, p -> element_at(own, p))), 0))"
    found = connected_subsets(records.withColumn("own", F.expr(of_sheet)), 5, fits, keep=("own",), alive=None if any_sheets else f"{held} <= 2")
    now = found.select("record_id", "rows", "places", F.expr("transform(places, p -> element_at(own, p))").alias("s"), *[F.col("places")[k - 1].alias(f"p{k}") for k in range(1, 6)])
    if not any_sheets:
        now = now.where("size(array_remove(array_distinct(s), 0)) = 2")
    bits = [F.expr(f"CASE WHEN {code_at('rows', f'p{a}', f'p{b}')} <> '-' THEN '1' ELSE '0' END") for a in range(1, 6) for b in range(a + 1, 6)]
    part = "array_join(transform(s, x -> size(array_distinct(slice(s, 1, cast(array_position(s, x) as int) - 1)))), '')"
    return now.select("record_id", F.concat_ws(",", "places").alias("positions"), F.expr(part).alias("partition"), F.concat(*bits).alias("contacts"))
