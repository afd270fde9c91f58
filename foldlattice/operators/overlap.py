"""Joins of segments with domains by the residues they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_domains(segments: DataFrame, domains: DataFrame) -> DataFrame:
    """``record_id, motif, domain, shared, whole``: the first domain that holds over half of a motif's residues.

    ``segments`` (record_id, motif, chain, lo, hi), ``domains`` (record_id, domain, place, chain, lo, hi):
    a domain's ranges are rows, in the order of ``place``; a null chain is any chain, and without lo and hi
    the whole chain belongs to it.  A segment over a range's edge counts up to that edge.
    """
    both = segments.alias("s").join(domains.alias("d"), "record_id").where("d.chain IS NULL OR lower(d.chain) = lower(s.chain)")
    shared = F.when(F.col("d.lo").isNull(), F.col("s.hi") - F.col("s.lo") + 1).otherwise(F.greatest(F.lit(0), F.least("s.hi", "d.hi") - F.greatest("s.lo", "d.lo") + 1))
    per = both.groupBy("record_id", "motif", "domain", "place").agg(F.sum(shared).alias("shared"))
    whole = segments.groupBy("record_id", "motif").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("whole"))
    found = per.join(whole, ["record_id", "motif"]).where("2 * shared > whole")
    return found.groupBy("record_id", "motif", "whole").agg(F.min_by(F.struct("domain", "shared"), "place").alias("b")).select("record_id", "motif", "b.domain", F.col("b.shared").alias("shared"), "whole")
