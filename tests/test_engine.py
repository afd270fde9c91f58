"""Engine queries against their SQL twins and brute force on the smallest tables."""

import itertools
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice import queries as Q
from foldlattice.functions import geometry as G
from foldlattice.operators import lattice as L
from foldlattice.operators import sketches as K
from foldlattice.operators import statistics as S
from foldlattice.operators.search import parity_of_sheets
from foldlattice.operators.signatures import connected_subsets
from foldlattice.plans.motif import MotifError, parse_motif, write_motif
from foldlattice.queries.motifs import MOTIFS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SLOW = {"skeleton_counts", "rcc_counts"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def plain(df):
        rows = [tuple(None if pd.isna(v) else round(float(v), 7) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False)]
        return sorted(rows, key=str)

    assert plain(a) == plain(b)


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) - SLOW))
def test_against_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).df()
    for c in got.columns:  # whole numbers compare as such
        if str(got[c].dtype).startswith("int") or str(want[c].dtype).startswith("int"):
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    same(got, want)


def test_search_against_combinations(spark):
    motif = MOTIFS["t4"]
    records = X.topological(spark, "/root/testdata/sf0.001").collect()
    accepts = {"X": set("ctuvN-"), "x": set("ctuvN"), "T": set("vt"), "C": set("uc")}
    want = set()
    for r in records:
        for pick in itertools.combinations(range(r["n"]), motif.k):
            e = [r["elements"][p] for p in pick]
            ok = all(t in ("X", x["etype"]) for t, x in zip(motif.types, e)) and len({x["chain"] for x in e}) == 1
            ok = ok and all(r["rows"][pick[i - 1]][pick[j - 1] - pick[i - 1]] in accepts.get(c, {c}) for (i, j), c in motif.codes.items())
            if ok:
                want.add((r["record_id"], ",".join(str(p + 1) for p in pick)))
    got = {(r["record_id"], r["positions"]) for r in Q.queries()["motif_k4"](spark, SF).collect()}
    assert got == want


def test_motif_text():
    for name, motif in MOTIFS.items():
        assert parse_motif(name, write_motif(motif)) == motif
    for bad in ("2 1\nE E\n* x\n*", "1 2\nE Q\n* x\n*", "1 2\nE E\n* q\n*", "1 2\nE E\n* x\n*\nsheetS 1 3", "1 2\nE E\n* x\n*\nnonsense", "1 2\nE E\n* x"):
        with pytest.raises(MotifError):
            parse_motif("bad", bad)


def test_enumeration_counts(spark):
    assert [L.skeletons(spark, n).count() for n in (1, 2, 3, 4)] == [1, 1, 5, 42]
    mirror = tuple((q + r, -r) for q, r in ((0, 0), (1, 0), (0, 1)))
    assert L.canonical(mirror) != L.canonical(((0, 0), (1, 0), (0, 1)))
    assert L.canonical(tuple(L.turned((q + 3, r - 2), 2) for q, r in ((0, 0), (1, 0), (0, 1)))) == L.canonical(((0, 0), (1, 0), (0, 1)))


def test_geometry_is_rigid(spark):
    rng = random.Random(5)
    axes = [[rng.uniform(-20, 20) for _ in range(6)] for _ in range(3)]
    a, b = 0.7, -1.1

    def move(p, mirror=1):
        x, y, z = p
        x, y = x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)
        y, z = y * math.cos(b) - z * math.sin(b), y * math.sin(b) + z * math.cos(b)
        return [mirror * (x + 5), y - 3, z + 11]

    def measure(rows):
        cols = [f"{e}{k}" for e in "fl" for k in "xyz"]
        df = spark.createDataFrame([tuple(zip(*[iter(sum(rows, []))] * 6))], [f"r{i}" for i in range(3)])
        for i in range(3):
            df = df.selectExpr("*", f"named_struct({', '.join(f'{c!r}, r{i}._{j + 1}' for j, c in enumerate(cols))}) AS e{i}")
        return df.selectExpr(f"round({G.angle('e0', 'e1')}, 6)", f"round({G.overlap('e0', 'e1')}, 6)", f"round({G.distance('e0', 'e1')}, 6)", G.chirality("e0", "e1", "e2")).first()

    plain = measure(axes)
    turned = measure([move(r[:3]) + move(r[3:]) for r in axes])
    mirrored = measure([move(r[:3], -1) + move(r[3:], -1) for r in axes])
    assert plain == turned and plain[:3] == mirrored[:3] and {plain[3], mirrored[3]} == {"R", "L"}


def parities(rows):
    """For each pair i < j joined by c and t contacts: t's along a shortest path, modulo two, the even one among equals."""
    near = {}
    for i, row in enumerate(rows, 1):
        for d, code in enumerate(row):
            if code in ("c", "t"):
                near.setdefault(i, []).append((i + d, int(code == "t")))
                near.setdefault(i + d, []).append((i, int(code == "t")))
    out = {}
    for begin in near:
        seen, front = {begin: 0}, {begin: 0}
        while front:
            step = {}
            for x, t in front.items():
                for y, own in near[x]:
                    if y not in seen:
                        step[y] = min(step.get(y, 2), (t + own) % 2)
            seen |= step
            front = step
        out |= {(begin, y): t for y, t in seen.items() if y > begin}
    return out


def test_parities(spark):
    assert parities(["*tc-", "*--", "*t", "*"]) == {(1, 2): 1, (1, 3): 0, (1, 4): 1, (2, 3): 1, (2, 4): 0, (3, 4): 1}
    rng = random.Random(3)
    held = [["*" + "".join(rng.choice("ct------uN") for _ in range(n - i)) for i in range(1, n + 1)] for n in [0, 1, 2, 4, 9, 15] * 6 + [70]]
    df = spark.createDataFrame([(k, rows) for k, rows in enumerate(held)], "record_id int, rows array<string>")
    got = {r["record_id"]: r["parity"] for r in parity_of_sheets(df).collect()}
    assert got == {k: [f"{i}-{j}={t}" for (i, j), t in sorted(parities(rows).items())] for k, rows in enumerate(held)}
    assert "ArrowPython" not in parity_of_sheets(df)._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in parity_of_sheets(df)._jdf.queryExecution().executedPlan().toString()


def test_connected_subsets(spark):
    """Every connected subset once, on sparse and dense records, and few rows on a record of 150 elements in a ring."""
    rng = random.Random(4)
    held = [["*" + "".join(rng.choice("t" + "-" * thin) for _ in range(n - i)) for i in range(1, n + 1)] for n, thin in ((5, 1), (8, 2), (9, 4), (11, 3), (6, 0), (4, 0))]
    ring = ["*" + "".join("u" if j == i + 1 or (i, j) == (1, 150) else "-" for j in range(i + 1, 151)) for i in range(1, 151)]
    df = spark.createDataFrame([(k, len(rows), rows) for k, rows in enumerate([*held, ring])], "record_id int, n int, rows array<string>")
    for k in (2, 4, 5):
        got = sorted((r["record_id"], tuple(r["places"])) for r in connected_subsets(df, k, "p <> 3").collect())
        want = []
        for at, rows in enumerate(held):
            for places in itertools.combinations([p for p in range(1, len(rows) + 1) if p != 3], k):
                reach, todo = {places[0]}, [places[0]]
                while todo:
                    x = todo.pop()
                    new = {y for y in places if y not in reach and rows[min(x, y) - 1][abs(x - y)] != "-"}
                    reach |= new
                    todo += new
                if len(reach) == k:
                    want.append((at, places))
        assert [g for g in got if g[0] < len(held)] == sorted(want) and len(got) == len(set(got))
        assert sum(g[0] == len(held) for g in got) == 149 - k + 1  # C(149, 5) subsets are over 500 million



def test_exact_tests(spark):
    assert S.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert S.binomial_two_sided(2, 10, 0.5) == pytest.approx(0.109375)
    rows = Q.queries()["fisher_exact"](spark, SF).collect()
    assert rows and all(0 <= r["p"] <= r["q"] <= 1 for r in rows)
    assert all(r["p_binom"] == pytest.approx(S.binomial_two_sided(r["k"], r["n"], 0.5), abs=1e-6) for r in Q.queries()["binom_test"](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_extensions():
    from foldlattice.plans.extension import contacts_only, extended

    made = extended(MOTIFS["t2"])
    assert len(made) == len({write_motif(m) for m in made}) and all(m.k == 3 and parse_motif(m.motif_id, write_motif(m)) == m for m in made)
    loose = contacts_only(MOTIFS["g3_right"])
    assert not loose.handedness and set(loose.codes.values()) <= {"x", "X", "-", "N"}


def _plain_chances(ps, most):
    d = [1.0]
    for p in ps:
        d = [a * (1 - p) + b * p for a, b in zip([*d, 0.0], [0.0, *d])][: most + 1]
    return d


def test_long_poisson_binomial(spark):
    """A group of 10,000 trials beside small ones, in pieces over several tasks; nulls are no trials."""
    rng = random.Random(8)
    rows = [("long", rng.random() / 2000) for _ in range(10_000)] + [("one", 0.25)] + [("few", p) for p in (0.0, 1.0, 0.5, None)] + [("none", None)]
    df = spark.createDataFrame(rows, "cell string, p double").repartition(7)
    for piece, fan in ((256, 16), (64, 2), (100_000, 16)):
        got = {r["cell"]: list(r["chances"]) for r in S.poisson_binomial(df, ["cell"], "p", 5, piece, fan).collect()}
        assert set(got) == {"long", "one", "few"}
        for cell, chances in got.items():
            assert chances == pytest.approx(_plain_chances([p for c, p in rows if c == cell and p is not None], 5), abs=1e-9)
    assert S.poisson_binomial(df.limit(0), ["cell"], "p", 5).count() == 0


def test_exact_samples(spark):
    """Samples have their exact sizes whatever the ties, are nested, and hold the least hashes."""
    rng = random.Random(5)
    rows = [(rep, k, rng.choice([7, 7, rng.randrange(1000)])) for rep in (1, 2) for k in range(400)] + [(3, k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "rep int, id int, h long").repartition(4)
    for buckets in (4096, 3, 1):
        got = S.exact_samples(df, F.col("h"), 1000, F.col("id"), [1, 10, 57, 300, 5000], ["rep"], buckets).collect()
        for rep in (1, 2, 3):
            own = sorted((h, k) for r, k, h in rows if r == rep)
            for size in (1, 10, 57, 300, 5000):
                assert sorted((r["h"], r["id"]) for r in got if (r["rep"], r["size"]) == (rep, size)) == own[:size]
    assert S.exact_samples(df.limit(0), F.col("h"), 1000, F.col("id"), [3], ["rep"]).count() == 0


def test_sketches_of_parts(spark, tmp_path):
    """Estimates of 60,000 items lie within the bound; a part that is written again replaces itself alone."""
    path = str(tmp_path / "sketches")
    items = spark.range(60_000).select((F.col("id") % 2).alias("cell"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("side"), (F.col("id") % 4).alias("part"), F.pmod(F.col("id"), F.lit(20_000)).alias("item"))
    K.store_sketches(items, ["cell", "side"], "part", "item", path)
    exact = items.groupBy("cell").agg(F.countDistinct("item").alias("n")).collect()
    got = {r["cell"]: r["n"] for r in K.merged(spark, path, ["cell"]).select("cell", F.theta_sketch_estimate("sketch").alias("n")).collect()}
    assert all(abs(got[r["cell"]] - r["n"]) <= K.BOUND * r["n"] and r["n"] > 2**K.LOG for r in exact)
    for r in K.shared(spark, path, ["cell"], "side", "a", "b").collect():
        sides = {s: {x["item"] for x in items.where((F.col("cell") == r["cell"]) & (F.col("side") == s)).select("item").distinct().collect()} for s in "ab"}
        either = len(sides["a"] | sides["b"])
        assert abs(r["both"] - len(sides["a"] & sides["b"])) <= K.BOUND * either and abs(r["either"] - either) <= K.BOUND * either
    K.store_sketches(items.where("part = 1 AND item < 10"), ["cell", "side"], "part", "item", path)
    left = {r["part"]: r["n"] for r in spark.read.parquet(path).groupBy("part").agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", K.LOG)).alias("n")).collect()}
    assert left[1] < 10 and all(left[p] > 4000 for p in (0, 2, 3))
    assert K.shared(spark, path, ["cell"], "side", "a", "none").select("both").distinct().collect()[0][0] == 0


def test_depth_of_full_cells(spark, tmp_path):
    """Folds with so many hits that none can be missed: no spread, and no logarithm of what is left."""
    orders = [(20 * i + sk, i % 40, "P" if sk == 0 and i % 2 else "F", float(i)) for sk in (0, 1) for i in range(40_000)] + [(20 * i + 2, i, "P", 1.0) for i in range(40)]
    tables = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").withColumn("o_orderdate", F.lit("1995-01-01").cast("timestamp")),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "cast(id % 5 as int) AS c_nationkey", "'a' AS c_mktsegment"),
        "nation": spark.range(5).selectExpr("cast(id as int) AS n_nationkey", "cast(0 as int) AS n_regionkey"),
    }
    con = duckdb.connect()
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = Q.queries()["depth_corrected"](spark, str(tmp_path)).toPandas()
    want = con.execute(Q.oracle_sql()["depth_corrected"]).df()
    same(got, want)
    assert got.set_index("sk")["p"].loc[[0, 1]].tolist() == [1.0, 0.0] and got.set_index("sk")["sd"].loc[0] == 0
    spark.range(0).selectExpr("id AS o_orderkey", "id AS o_custkey", "'P' AS o_orderstatus", "1d AS o_totalprice", "current_timestamp() AS o_orderdate").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert Q.queries()["depth_corrected"](spark, str(tmp_path)).count() == 0
    sure = spark.createDataFrame([(1, 1.0), (1, 0.5), (2, 0.5)], "g int, p double").groupBy("g").agg(S.no_hit_probability("p").alias("none"))
    assert {r["g"]: r["none"] for r in sure.collect()} == {1: 0.0, 2: 0.5}


def test_codes_of_keys(spark):
    """Codes of all pairs of keys and types; an element without a key has blank codes and takes its place."""
    letters = [(k, t) for k in (*range(9), None) for t in "HE"]
    lines = spark.createDataFrame([(1, [("d", i, k, 1, 1.0, 1.0, {"H": "A", "E": "R"}[t], "O") for i, (k, t) in enumerate(letters)])], "record_id long, lines array<struct<l_shipdate:string,l_linenumber:int,l_partkey:long,l_suppkey:long,l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string>>")
    rows = X._of_lines(lines).first()["rows"]

    def code(a, b):
        c = "-" if None in (a[0], b[0]) else X.KEY_CODES[(a[0] + b[0]) % 8]
        return "-" if c in "ct" and (a[1], b[1]) != ("E", "E") else c

    assert rows == ["*" + "".join(code(a, b) for b in letters[i + 1 :]) for i, a in enumerate(letters)]
