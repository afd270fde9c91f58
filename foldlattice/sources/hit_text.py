"""Hit text: MOTIF blocks of segment lines, and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = r"segment-Type: (\S) Position:\s*(\d+) Range:\s*(\S+?)--\s*(\S+) (\S) Length:\s*(\d+)"


def render(hits: DataFrame) -> DataFrame:
    """``query_id, record_id, text`` of hits (query_id, record_id, motif_idx, segments)."""
    segment = "format_string('segment-Type: %s Position:%4d Range:%5s--%5s %s Length:%4d', s.etype, s.pos, s.begin, s.end, s.chain, s.length)"
    block = hits.select("query_id", "record_id", "motif_idx", F.expr(f"concat('MOTIF:\n', array_join(transform(segments, s -> {segment}), '\n'))").alias("block"))
    # a record's motifs make one file, as the format has it
    return block.groupBy("query_id", "record_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("motif_idx", "block"))), lambda b: b["block"]), "\n"), F.lit("\nEND\n")).alias("text"))


def parse(texts: DataFrame) -> DataFrame:
    """``query_id, record_id, motif_idx, segments`` of hit texts; labels stay text, insertion codes and signs included."""
    blocks = texts.select("query_id", "record_id", F.posexplode(F.filter(F.split("text", "MOTIF:"), lambda b: F.trim(b) != "")).alias("motif", "block"))
    parts = [F.expr(f"regexp_extract_all(block, r'{SEGMENT}', {g})").alias(f"g{g}") for g in range(1, 7)]
    zipped = F.expr("transform(arrays_zip(g1, g2, g3, g4, g5, g6), z -> named_struct('etype', z.g1, 'pos', cast(z.g2 as int), 'begin', z.g3, 'end', z.g4, 'chain', z.g5, 'length', cast(z.g6 as int)))")
    return blocks.select("query_id", "record_id", (F.col("motif") + 1).alias("motif_idx"), *parts).select("query_id", "record_id", "motif_idx", zipped.alias("segments"))
