"""Fixed-width record text: header with elements, sheet lines, one packed matrix line.

``write`` and ``parse`` of ``read_lines`` are inverse up to the three decimals of coordinates.  Line order
counts, so lines carry their place within their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Field places (fixed values of the format, from 1 for ``substring``).
ID_WIDTH, COUNT_AT, ELEMENTS_AT, ELEMENT_WIDTH = 32, 33, 37, 68
POINTS = ("fx", "fy", "fz", "lx", "ly", "lz")


def render(records: DataFrame, id_column: str = "record_id") -> DataFrame:
    """``record_id, place, line`` of each record: elements carry type, chain, labels, length and points."""
    coords = ", ".join(f"e.{p}" for p in POINTS)
    element = f"format_string('%1s%1s%5s--%5s %4d %8.3f%8.3f%8.3f%8.3f%8.3f%8.3f', e.etype, e.chain, e.begin_label, e.end_label, e.length, {coords})"
    header = F.expr(f"concat(rpad(concat({id_column}, '.ssd'), {ID_WIDTH}, ' '), lpad(n, 4, ' '), array_join(transform(elements, e -> {element}), ''))")
    sheets = F.expr("CASE WHEN size(sheets) = 0 THEN array('sheet    0') ELSE transform(sheets, (s, i) -> concat('sheet ', lpad(i + 1, 6, ' '), lpad(size(s), 6, ' '), array_join(transform(s, p -> lpad(p, 6, ' ')), ''))) END")
    lines = F.concat(F.array(header), sheets, F.array(F.expr("array_join(rows, '')")))
    return records.select(F.col(id_column).alias("record_id"), F.posexplode(lines).alias("place", "line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Kind of each line of ``file, at, line[, block]`` and the running number of its header within the file.

    ``block`` is the file's split that a line was read in: headers are counted by split, the splits' few
    counts are summed up, and lines are numbered within their split.
    """
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").startswith("sheet "), "sheet").when(F.substring("line", 1, 32).contains(".ssd"), "header").when(F.col("line").startswith("*"), "matrix").otherwise("other")
    own = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    own = own.withColumn("kind", kind)
    heads = own.groupBy("file", "block").agg(F.count_if(F.col("kind") == "header").alias("heads"))
    before = heads.select("file", "block", F.coalesce(F.sum("heads").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum((F.col("kind") == "header").cast("int")).over(W.partitionBy("file", "block").orderBy("at"))
    return own.withColumn("within", within).join(before, ["file", "block"]).withColumn("record", F.col("within") + F.col("before")).drop("within", "before")


def _element(at: str) -> str:
    def cut(begin: int, size: int) -> str:
        return f"substring(header, {at} + {begin}, {size})"

    points = ", ".join(f"'{p}', try_cast({cut(20 + 8 * k, 8)} as double)" for k, p in enumerate(POINTS))
    return f"named_struct('etype', {cut(0, 1)}, 'chain', {cut(1, 1)}, 'begin_label', trim({cut(2, 5)}), 'end_label', trim({cut(9, 5)}), 'length', try_cast(trim({cut(15, 4)}) as int), {points})"


def parse(lines: DataFrame) -> DataFrame:
    """``record_id, n, elements, sheets, rows`` of well-formed records of ``file, at, line``.

    A header without a matrix, or whose length doesn't fit its count, gives no record.
    """
    grouped = numbered(lines).where("record > 0").groupBy("file", "record").agg(
        F.max(F.when(F.col("kind") == "header", F.col("line"))).alias("header"),
        F.min_by(F.when(F.col("kind") == "matrix", F.col("line")), F.when(F.col("kind") == "matrix", F.struct("block", "at"))).alias("matrix"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "sheet", F.struct("block", "at", "line")))).alias("sheet_lines"),  # a record's own few lines
    )
    n = F.expr(f"try_cast(trim(substring(header, {COUNT_AT}, 4)) as int)")
    whole = grouped.withColumn("n", n).where(f"n > 0 AND matrix IS NOT NULL AND length(header) = {ELEMENTS_AT - 1} + {ELEMENT_WIDTH} * n")
    member = "transform(sequence(1, cast(trim(substring(l.line, 13, 6)) as int)), k -> cast(trim(substring(l.line, 13 + 6 * k, 6)) as int))"
    return whole.select(
        F.expr(f"regexp_extract(substring(header, 1, {ID_WIDTH}), '^(.*)[.]ssd', 1)").alias("record_id"),
        "n",
        F.expr(f"transform(sequence(0, n - 1), i -> {_element(f'({ELEMENTS_AT} + {ELEMENT_WIDTH} * i)')})").alias("elements"),
        F.expr(f"transform(filter(sheet_lines, l -> length(l.line) >= 24), l -> {member})").alias("sheets"),
        F.expr("transform(slice(split(matrix, '[*]'), 2, n), r -> concat('*', r))").alias("rows"),
    )


def _checked(own: DataFrame) -> DataFrame:
    """One row a header (or the lines before the first): what it has and lacks."""
    per = own.groupBy("file", "record").agg(
        F.max(F.when(F.col("kind") == "header", F.col("line"))).alias("header"), F.count_if(F.col("kind") == "header").alias("headers"), F.count_if(F.col("kind") == "matrix").alias("matrices"), F.count_if(F.col("kind").isin("sheet", "matrix")).alias("blocks"), F.count_if(F.col("kind") == "other").alias("other")
    )
    n = F.coalesce(F.expr(f"try_cast(trim(substring(header, {COUNT_AT}, 4)) as int)"), F.lit(-1))
    return per.withColumn("overflow", (F.col("headers") > 0) & (F.length("header") != ELEMENTS_AT - 1 + ELEMENT_WIDTH * n)).withColumn("sound", (F.col("headers") > 0) & (F.col("matrices") > 0) & ~F.col("overflow"))


def validate(lines: DataFrame) -> DataFrame:
    """``problem, n``: records and what is wrong with the rest."""
    checks: dict[str, Column] = {
        "records": F.count_if("sound"),
        "header_no_matrix": F.count_if((F.col("headers") > 0) & (F.col("matrices") == 0)),
        "orphan_block": F.count_if((F.col("headers") == 0) & (F.col("blocks") > 0)),
        "extra_matrix": F.coalesce(F.sum(F.when(F.col("headers") > 0, F.greatest(F.col("matrices") - 1, F.lit(0)))), F.lit(0)),
        "field_overflow": F.count_if("overflow"),
        "stray": F.coalesce(F.sum("other"), F.lit(0)),
    }
    wide = _checked(numbered(lines)).agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks))).alias("problem", "n"))


def clean(lines: DataFrame) -> DataFrame:
    """The lines, with the columns given, of well-formed records only: header, sheet lines and first matrix."""
    own = numbered(lines)
    sound = _checked(own).where("sound").select("file", "record")
    kept = own.where(F.col("kind").isin("header", "sheet", "matrix")).join(sound, ["file", "record"], "left_semi")
    first = F.row_number().over(W.partitionBy("file", "record", "kind").orderBy("block", "at"))
    return kept.withColumn("nth", first).where("kind <> 'matrix' OR nth = 1").select(*lines.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, line``: lines in order within the split of the file that they were read in, however large the file."""
    own = spark.read.text(path)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def write(records: DataFrame, path: str, chunks: int) -> None:
    """Record text in ``chunks`` files, every record whole in one of them."""
    lines = render(records).groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("value"))
    lines.repartition(chunks, "record_id").select("value").write.text(path)
