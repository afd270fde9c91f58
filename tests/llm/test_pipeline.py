"""The pipeline equals its stages run by hand."""

from pyspark.sql import functions as F

import corpus_pipeline
from foldlattice.llm.dedup import near_duplicates
from foldlattice.llm.quality_classifier import quality_classifier
from foldlattice.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = set(held)
    for judge in (lambda d: quality_classifier(d, labels), quality_rules, lambda d: near_duplicates(d, percent=80)):
        own = spark.createDataFrame([held[i] for i in sorted(keep)], docs.schema)
        keep = {r["doc_id"] for r in judge(own).where("kept").select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == keep and 0 < len(keep) < len(held)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_columns_of_any_name(spark):
    """Names that the stages use inside, dots and blanks come through each stage with their values."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    names = ["copy", "__copy", "_copy", "a.b", "judged_kept", "__judged_kept", "perplexity", "kept", "d2", "node", "root", "h", "set_key", "with blank", "v.kept", "`q`"]
    docs = docs.select("*", *[F.lit(77 + k).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        kept = out.collect()
        assert kept and all(r[n] == 77 + k for r in kept for k, n in enumerate(names)), name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 80


def test_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("kept", F.lit("x"))
    twice = docs.unionByName(docs).unionByName(docs.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, twice, SF).columns == twice.columns
    left = corpus_pipeline.deduplicate(spark, twice, SF)
    assert left.count() == left.select("doc_id").distinct().count() > 0


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
