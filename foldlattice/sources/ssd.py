"""Structure card text: atoms, element cards and hydrogen-bond pairs.

All readers take ``file, at, line`` and work on fixed columns (from 1): label and chain together name a residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cut(at: int, size: int):
    return F.substring("line", at, size)


def is_residue() -> Column:
    """Whether a line is an alpha carbon."""
    return (F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM")) & (F.trim(_cut(13, 4)) == "CA")


def atom_of() -> Column:
    """``chain, label, x, y, z`` of an alpha carbon's line, null for others."""
    place = [F.expr(f"try_cast(trim(substring(line, {31 + 8 * k}, 8)) as double)").alias(c) for k, c in enumerate("xyz")]
    return F.when(is_residue(), F.struct(_cut(22, 1).alias("chain"), _cut(23, 5).alias("label"), *place))


def residues(lines: DataFrame) -> DataFrame:
    """``file, chain, label, idx, x, y, z``: alpha carbons up to the first ENDMDL, numbered from 2; a repeated residue counts once."""
    ends = lines.where(F.col("line").startswith("ENDMDL")).groupBy("file").agg(F.min("at").alias("end_at"))
    atoms = lines.where(is_residue()).join(ends, "file", "left").where(F.col("end_at").isNull() | (F.col("at") < F.col("end_at")))
    parts = atoms.select("file", "at", atom_of().alias("of")).select("file", "at", "of.*")
    first = parts.groupBy("file", "chain", "label").agg(F.min("at").alias("at"), *[F.min_by(c, "at").alias(c) for c in "xyz"])
    return first.withColumn("idx", F.row_number().over(W.partitionBy("file").orderBy("at")) + 1).select("file", "chain", "label", "idx", "x", "y", "z")


#: Columns of each element card: chain, begin label, end label, length; and the type it gives (fixed values).
CARDS = {"HELIX": (20, 22, 34, 72, "H"), "SHEET": (22, 23, 34, 72, "E"), "LINKER": (20, 22, 34, 72, "L")}


def card_of() -> Column:
    """``etype, chain, begin_label, end_label, length, sheet, excluded`` of an element card's line, null for others."""
    out = F.lit(None)
    for card, (chain, begin, end, size, etype) in CARDS.items():
        sheet, excluded = (F.trim(_cut(12, 3)), _cut(71, 1) == "m") if card == "SHEET" else (F.lit(None).cast("string"), F.lit(False))
        length = F.expr(f"try_cast(trim(substring(line, {size}, 5)) as int)")
        own = F.struct(F.lit(etype).alias("etype"), _cut(chain, 1).alias("chain"), _cut(begin, 5).alias("begin_label"), _cut(end, 5).alias("end_label"), length.alias("length"), sheet.alias("sheet"), excluded.alias("excluded"))
        held = F.col("line").startswith(card)
        out = F.when(held & (_cut(20, 1) == _cut(32, 1)) if card == "LINKER" else held, own).otherwise(out)
    return out


def elements(lines: DataFrame) -> DataFrame:
    """``file, at, etype, chain, begin_label, end_label, length, sheet, excluded``: one row a card.

    ``sheet`` is a strand's sheet name, ``excluded`` marks strands flagged ``m``; linkers between two chains are dropped.
    """
    return lines.select("file", "at", card_of().alias("of")).where("of IS NOT NULL").select("file", "at", "of.*")


def pair_of() -> Column:
    """``a_chain, a_label, b_chain, b_label`` of a bond's line, null for others; four places of a serial number shift its columns."""
    size = F.length(F.replace(_cut(8, 6), F.lit(" "), F.lit("")))
    wide = F.raise_error(F.concat(F.lit("PAIRS card with a serial number of over four places: "), "line")).cast("int")
    shift = F.when(size > 4, wide).when(size == 4, 1).otherwise(0)
    parts = [F.substr("line", F.lit(at) + shift, F.lit(n)).alias(name) for name, at, n in (("a_chain", 20, 1), ("a_label", 22, 5), ("b_chain", 32, 1), ("b_label", 34, 5))]
    return F.when(F.col("line").startswith("PAIRS"), F.struct(*parts))


def bonds(lines: DataFrame) -> DataFrame:
    """``file, at, a_chain, a_label, b_chain, b_label``: each pair in both directions.

    A serial number of four places shifts its columns by one; a longer one is an error.
    """
    one = lines.select("file", "at", pair_of().alias("of")).where("of IS NOT NULL").select("file", "at", "of.*")
    return one.unionByName(one.select("file", "at", F.col("b_chain").alias("a_chain"), F.col("b_label").alias("a_label"), F.col("a_chain").alias("b_chain"), F.col("a_label").alias("b_label"))).dropDuplicates(["file", "a_chain", "a_label", "b_chain", "b_label"])


def mean_confidence(lines: DataFrame) -> DataFrame:
    """``file, confidence``: mean over alpha carbons of the number in an atom's last data column."""
    atoms = lines.where(F.col("line").startswith("ATOM") & (F.trim(_cut(13, 4)) == "CA"))
    return atoms.groupBy("file").agg(F.avg(F.expr("try_cast(trim(substring(line, 61, 6)) as double)")).alias("confidence"))
