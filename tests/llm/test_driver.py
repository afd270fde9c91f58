"""What the pipeline's stages ask of the driver: it keeps a buffer for each job and broadcast, so they make few."""

import os
import random

from pyspark.sql import functions as F

from foldlattice.llm.common import components, shared_folder
from foldlattice.llm.quality_rules import FEATURES, robust_fit


def edge_tables(spark) -> int:
    folder = f"{shared_folder(spark).removeprefix('file://')}/tables"
    return sum(name.startswith("edges-") for name in os.listdir(folder)) if os.path.isdir(folder) else 0


def jobs(spark, name, work) -> int:
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_stars_need_no_round(spark):
    edges = [(2 * i, 2 * i + 1) for i in range(30)] + [(100, k) for k in range(101, 120)] + [(1, 0), (5, 5)]
    before = edge_tables(spark)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: i // 2 * 2 for i in range(60)} | {k: 100 for k in range(100, 120)}
    assert edge_tables(spark) == before + 1


def test_chains_and_hubs(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(10_000), 200)
    edges = list(zip(nodes[:60], nodes[1:60])) + [(nodes[60], n) for n in nodes[61:120]] + [tuple(rng.sample(nodes[120:], 2)) for _ in range(70)]
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    met = {n for e in edges for n in e}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(met) and {r["node"]: r["root"] for r in rows} == {n: root[n] for n in met}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_a_concentration_step_joins_figures_once(spark):
    """A step of the fit ran 12 jobs when cut, fit and movement were joined and gathered each on their own."""
    rows = spark.range(900).select((F.col("id") % 3).alias("grp"), *[(F.rand(7 + i) + F.col("id") % 5).alias(f) for i, f in enumerate(FEATURES)]).localCheckpoint()
    one, three = (jobs(spark, f"steps{n}", lambda: robust_fit(rows, 0.75, n, still=-1).collect()) for n in (1, 3))
    assert (three - one) / 2 <= 9
