"""Corpora, sweeps with constraints, worked geometry, readers and archives."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlattice import fixtures as X
from foldlattice.functions import geometry as G
from foldlattice.operators import corpus as C
from foldlattice.operators import lattice as L
from foldlattice.operators.overlap import majority_domains
from foldlattice.operators.projection import by_chain
from foldlattice.operators.search import parity_of_sheets, search
from foldlattice.operators.spread import cell_spread, principal_axis, superposed_distances
from foldlattice.operators.statistics import binomial_greater, normal_cdf
from foldlattice.operators.sweep import deal, sweep
from foldlattice.plans.motif import MotifError, parse_motif, write_motif
from foldlattice.queries import enumeration
from foldlattice.sources import archive, metamatrix
from foldlattice.sources.motif_files import listed_motif, listed_motifs, read_motifs

SF = "/root/testdata/sf0.001"


def test_six_point_skeletons(spark):
    assert L.skeletons(spark, 6).count() == 2372


def test_typed_motif_of_a_bent_sheet():
    m = C.typed_motif("m", ((0, 0), (1, 0), (0, 1), (3, 0)), "EEHE")
    assert m.codes == {(1, 2): "t", (1, 3): "C", (1, 4): "X", (2, 3): "T", (2, 4): "X", (3, 4): "X"}
    assert [(r.kind, r.elements) for r in m.requirements if r.kind.startswith("sheet")] == [("sheetS", (1, 2)), ("sheetD", (1, 4)), ("sheetD", (2, 4))]
    assert [(r.low, r.high) for r in m.requirements if r.kind == "length"] == [(5, 1000), (5, 1000), (8, 1000), (5, 1000)]
    signs = dict(zip([(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)], L.handedness(((0, 0), (1, 0), (0, 1), (3, 0)))))
    assert {h[:3]: h[3] for h in m.handedness} == {t: "R" if s > 0 else "L" for t, s in signs.items() if s}
    assert parse_motif("m", write_motif(m)) == m


def test_corpus_reads_back(spark):
    found = C.corpus(spark, 3)
    motifs = C.motifs(found)
    assert len(motifs) == 40 and all(parse_motif(m.motif_id, write_motif(m)) == m for m in motifs)
    assert C.motif_named(found, motifs[7].motif_id) == motifs[7]
    with pytest.raises(KeyError):
        C.motif_named(found, "s3-9999-0000")


def test_one_larger_contains_the_seed():
    seed = ((0, 0), (1, 0), (2, 0))
    made = C.one_larger(seed, "EEE", "t")
    assert made and len({(m.types, tuple(m.codes.items())) for m in made}) > 3
    for m in made:
        at = (1, 2, 3) if m.codes[1, 2] == m.codes[2, 3] == "x" and m.types[:3] == ("E",) * 3 else (2, 3, 4)
        assert not m.handedness and m.codes[at[0], at[1]] == m.codes[at[1], at[2]] == "x"
        assert any(set(at) <= set(r.elements) for r in m.requirements if r.kind == "sheetS")


def test_crowded():
    star = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    assert C.crowded(C.typed_motif("m", star, "EEEEE")) and not C.crowded(C.typed_motif("m", star, "HEEEE"))


def test_sweep_equals_search(spark):
    records = parity_of_sheets(X.geometric(spark, SF)).cache()
    motifs = [m for m in C.motifs(C.corpus(spark, 3))][::5]
    motifs += [parse_motif("p", "1 2 3\nE X E\n* X X\n* x\n*\nparallel 1 3\nchainAll"), parse_motif("a", "1 2\nE E\n* X\n*\nantiparallel 1 2")]
    got = {tuple(r) for r in sweep(records, motifs).collect()}
    assert got == {tuple(r) for r in sweep(records, motifs, tasks=40).collect()}
    want = set()
    for m in motifs:
        want |= {(r["query_id"], r["record_id"], r["positions"]) for r in search(records, m).collect()}
    assert got == want and len({q for q, *_ in got}) > 5
    with pytest.raises(ValueError):
        sweep(records, [])


def _plain_hits(record, motif):
    """Positions of a motif in one collected record, by trying all subsets."""
    accepted = {"X": "ctuvN-", "x": "ctuvN", "T": "vt", "C": "uc"}
    sheets = [set(s) for s in record["sheets"]]
    out = []
    for places in itertools.combinations(range(1, record["n"] + 1), motif.k):
        own = [record["elements"][p - 1] for p in places]
        if any(t not in ("X", e["etype"]) for t, e in zip(motif.types, own)) or motif.one_chain and len({e["chain"] for e in own}) > 1:
            continue
        if any(record["rows"][places[i - 1] - 1][places[j - 1] - places[i - 1]] not in accepted.get(c, c) for (i, j), c in motif.codes.items()):
            continue
        ok = True
        for r in motif.requirements:
            if r.kind == "length":
                ok &= r.low <= own[r.elements[0] - 1]["length"] <= r.high
            elif r.kind in ("sheetS", "sheetD"):
                ok &= (not sheets or any({places[i - 1] for i in r.elements} <= s for s in sheets)) == (r.kind == "sheetS")
        if ok and all(record["sense"][places[a - 1], places[b - 1], places[c - 1]] == side for a, b, c, side in motif.handedness):
            out.append(",".join(map(str, places)))
    return out


def test_whole_corpus_by_trying(spark):
    """All 6,336 five-element motifs over a few records, against plain enumeration by types."""
    records = X.geometric(spark, SF).where("record_id < 8").cache()
    motifs = C.corpus_motifs(spark, 5)
    got = {tuple(r) for r in sweep(records, motifs).collect()}
    e = [f"element_at(elements, {x})" for x in "ijm"]
    triples = records.selectExpr("record_id", "elements", "explode(sequence(1, 8)) AS i").selectExpr("*", "explode(sequence(i + 1, 9)) AS j").selectExpr("*", "explode(sequence(j + 1, 10)) AS m").selectExpr("record_id", "i", "j", "m", f"{G.chirality(*e)} AS side")
    senses = {}
    for r in triples.collect():
        senses.setdefault(r["record_id"], {})[r["i"], r["j"], r["m"]] = r["side"]
    want = set()
    for r in records.collect():
        held = r.asDict() | {"sense": senses[r["record_id"]]}
        kinds = {"".join(t) for t in itertools.combinations([e["etype"] for e in r["elements"]], 5)}
        want |= {(m.motif_id, r["record_id"], p) for m in motifs if "".join(m.types) in kinds for p in _plain_hits(held, m)}
    assert got == want and len(want) > 50


def test_motif_within_a_motif(spark):
    """A motif that another begins with ends inside the trie and is reported once; sizes share the scan."""
    records = X.topological(spark, SF)
    texts = {"a": "1 2\nE X\n* x\n*\nchainAll", "b": "1 2 3\nE X E\n* x X\n* C\n*\nchainAll", "c": "1 2 3 4\nE X E X\n* x X X\n* C x\n* X\n*\nchainAll", "again": "1 2\nE X\n* x\n*\nchainAll", "d": "1 2 3 4\nH X X X\n* X X X\n* X T\n* X\n*"}
    motifs = [parse_motif(name, text) for name, text in texts.items()]
    rows = [tuple(r) for r in sweep(records, motifs).collect()]
    assert sorted(rows) == sorted((r["query_id"], r["record_id"], r["positions"]) for m in motifs for r in search(records, m).collect())
    assert sorted(rows) == sorted(tuple(r) for r in sweep(records, motifs, tasks=500).collect())


def test_trie_dies_early(spark):
    """Subsets of the last level that meet no motif are not made: far fewer than C(n, 5) a record."""
    n = 40
    rows = ["*" + "".join("t" if (i + j) % 9 == 0 else "-" for j in range(i + 1, n + 1)) for i in range(1, n + 1)]
    element = "array<struct<etype:string,chain:string,length:int>>"
    records = spark.createDataFrame([(1, n, [("E", "A", 9)] * n, rows, [])], f"record_id int, n int, elements {element}, rows array<string>, sheets array<array<int>>")
    m = parse_motif("five", "1 2 3 4 5\nE E E E E\n* t X X X\n* t X X\n* t X\n* t\n*")
    out = sweep(records, [m])
    assert out.count() == len(_plain_five(rows, n)) > 0
    made = [metrics for metrics in _generated_rows(out)]
    assert max(made) < 658_008 / 20  # C(40, 5)


def _plain_five(rows, n):
    near = {i: [j for j in range(i + 1, n + 1) if rows[i - 1][j - i] == "t"] for i in range(1, n + 1)}
    paths = [(i,) for i in near]
    for _ in range(4):
        paths = [(*p, j) for p in paths for j in near[p[-1]]]
    return paths


def _generated_rows(df):
    """Rows that each explode of a plan made."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    out, queue = [], [plan]
    while queue:
        p = queue.pop()
        while p.nodeName() == "AdaptiveSparkPlan" or p.nodeName().endswith("QueryStage"):
            p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan()
        if p.nodeName() == "Generate":
            out.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        queue += [children.apply(i) for i in range(children.size())]
    return out


def test_dealt_units(spark):
    """Units cover every subset once, none costs much more than its share, and tasks get even sums."""
    sizes = [5, 6, 7, 60, 40, 30, 12, 9] + [8] * 200
    held = spark.createDataFrame([(i, list(range(1, m + 1))) for i, m in enumerate(sizes)], "record_id int, fit array<int>")
    k, tasks = 4, 4
    rows = deal(held, k, tasks).withColumn("task", F.spark_partition_id()).collect()
    whole = sum(math.comb(m, k) for m in sizes)
    cost, tasks_cost = {}, {}
    for r in rows:
        m = len(r["fit"])
        for q in range(r["q_from"], r["q_to"] + 1):
            seconds = [s for s in range(q + 1, m + 1) if r["parts"] == 1 or s % r["parts"] == r["part"]]
            for s in seconds:
                key = r["record_id"], q, s
                assert key not in cost
                cost[key] = math.comb(m - s, k - 2)
                tasks_cost[r["task"]] = tasks_cost.get(r["task"], 0) + cost[key]
    assert sum(cost.values()) == whole
    heavy = [c for t, c in tasks_cost.items()]
    assert max(heavy) < 1.6 * whole / tasks


def test_six_element_sweep(spark):
    records = X.topological(spark, SF)
    m = parse_motif("six", "1 2 3 4 5 6\nX X X X X X\n* x X X X X\n* X X X X\n* X x X\n* X X\n* T\n*\nchainD 1 6")
    assert {(r["record_id"], r["positions"]) for r in sweep(records, [m]).collect()} == {(r["record_id"], r["positions"]) for r in search(records, m).collect()}


def test_records_of_many_sheets(spark):
    sheets = [[p, p + 1] for p in range(1, 12)] * 7  # overlapping, more than a number has bits
    element = "array<struct<etype:string,chain:string,length:int>>"
    rows = ["*" + "t" * (12 - i) for i in range(1, 13)]
    records = spark.createDataFrame([(1, 12, [("E", "A", 9)] * 12, rows, sheets), (2, 12, [("E", "A", 9)] * 12, rows, sheets[:11]), (3, 12, [("E", "A", 9)] * 12, rows, [])], f"record_id int, n int, elements {element}, rows array<string>, sheets array<array<int>>")
    motifs = [parse_motif("s", "1 2 3\nE E E\n* X X\n* X\n*\nsheetS 1 2\nsheetD 2 3"), parse_motif("d", "1 2\nE E\n* X\n*\nsheetS 1 2")]
    got = {tuple(r) for r in sweep(records, motifs).collect()}
    assert got == {(r["query_id"], r["record_id"], r["positions"]) for m in motifs for r in search(records, m).collect()}
    assert {r for q, r, _ in got if q == "s"} == {1, 2} and {r for q, r, _ in got if q == "d"} == {1, 2, 3}


def _axes(spark, *rows):
    fields = ", ".join(f"{e}{c} double" for e in "fl" for c in "xyz")
    out = spark.range(1)
    for k, row in enumerate(rows):
        out = out.crossJoin(spark.createDataFrame([(row,)], f"e{k} struct<{fields.replace(' double', ':double')}>"))
    return out


def test_worked_geometry(spark):
    a, b, across = (0.0, 0.0, 0.0, 0.0, 0.0, 10.0), (4.0, 0.0, 6.0, 4.0, 0.0, 16.0), (4.0, 0.0, 5.0, 14.0, 0.0, 5.0)
    got = _axes(spark, a, b, across).selectExpr(G.angle("e0", "e1"), G.angle("e0", "e2"), G.overlap("e0", "e1"), G.distance("e0", "e1")).first()
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(90)
    # shadows on the line between midpoints (2,0,3)-(2,0,13): 0..10 and 6..16 along z share 4
    assert got[2] == pytest.approx(4)
    assert got[3] == pytest.approx(math.dist((0, 0, 5), (4, 0, 6)))
    # three parallel axes whose midpoints turn anticlockwise seen from their heads are right-handed
    up = [(x, y, -5.0, x, y, 5.0) for x, y in ((0.0, 0.0), (5.0, 0.0), (0.0, 5.0))]
    assert _axes(spark, *up).selectExpr(G.chirality("e0", "e1", "e2")).first()[0] == "R"
    assert _axes(spark, up[0], up[2], up[1]).selectExpr(G.chirality("e0", "e1", "e2")).first()[0] == "L"


def test_normal_and_binomial(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (-2.5,), (5.0,), (50.0,)], "x double").select(normal_cdf(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (0, 1, -2.5, 5, 50)], abs=1e-9)
    assert binomial_greater(8, 10, 0.5) == pytest.approx(56 / 1024) and binomial_greater(0, 5, 0.1) == 1


def test_spread(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert superposed_distances(base[None], (base @ q + 3)[None])[0] == pytest.approx(0, abs=1e-6)
    assert superposed_distances(base[None], (base * [1, 1, -1])[None])[0] > 0.1
    first, last = principal_axis(np.outer(np.arange(5), [0, 2, 0]))
    assert first == pytest.approx([0, 0, 0]) and last == pytest.approx([0, 8, 0])
    rows = [("x", i, [float(v) for v in (base + rng.normal(0, 0.1, base.shape)).ravel()]) for i in range(6)] + [("y", i, [0.0] * 24) for i in range(3)]
    got = cell_spread(spark.createDataFrame(rows, "cell string, motif int, points array<double>")).collect()
    pairs = [superposed_distances(np.reshape(rows[a][2], (1, 8, 3)), np.reshape(rows[b][2], (1, 8, 3)))[0] for a in range(6) for b in range(a)]
    assert [(r["cell"], r["motifs"]) for r in got] == [("x", 6)] and got[0]["spread"] == pytest.approx(np.median(pairs))


def test_majority_domains(spark):
    segments = spark.createDataFrame([("r", 1, "A", 1, 10), ("r", 1, "A", 31, 40), ("r", 2, "B", 1, 10)], "record_id string, motif int, chain string, lo long, hi long")
    domains = spark.createDataFrame([("r", "d1", 1, "A", 5, 12), ("r", "d1", 1, "a", 31, 36), ("r", "d2", 2, None, None, None)], "record_id string, domain string, place int, chain string, lo long, hi long")
    got = {(r["motif"], r["domain"], r["shared"]) for r in majority_domains(segments, domains).collect()}
    assert got == {(1, "d1", 12), (2, "d2", 10)}


def test_by_chain(spark):
    element = "array<struct<etype:string,chain:string,length:int>>"
    rows = [(1, 4, [("E", c, 9) for c in "BABA"], ["*ctu", "*vN", "*-", "*"], [[1, 2], [2, 4], [3]]), (2, 0, [], [], []), (3, 1, [("H", "A", 9)], ["*"], [])]
    got = {(r["record_id"], r["chain"]): (r["n"], r["rows"], r["sheets"], r["places"]) for r in by_chain(spark.createDataFrame(rows, f"record_id int, n int, elements {element}, rows array<string>, sheets array<array<int>>")).collect()}
    assert got == {(1, "B"): (2, ["*t", "*"], [[1], [2]], [1, 3]), (1, "A"): (2, ["*N", "*"], [[1], [1, 2]], [2, 4]), (3, "A"): (1, ["*"], [], [1])}


def test_room_for(spark):
    """Records with room for a motif: no hit lies outside of them; lists are compared place by place."""
    rng = random.Random(6)
    texts = {"star": "1 2 3 4\nE E E E\n* c t c\n* X X\n* X\n*", "path": "1 2 3\nE E E\n* c X\n* t\n*", "free": "1 2\nH E\n* X\n*", "square": "1 2 3 4\nE E E E\n* t X t\n* t X\n* t\n*"}
    motifs = [parse_motif(name, text) for name, text in texts.items()]
    rows = [(k, n, [("E", "A", 9)] * n, ["*" + "".join(rng.choice("ct----u") for _ in range(n - i)) for i in range(1, n + 1)], []) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7] * 6)]
    records = spark.createDataFrame(rows, "record_id int, n int, elements array<struct<etype:string,chain:string,length:int>>, rows array<string>, sheets array<array<int>>")
    got = {r["query_id"]: r["records"] for r in C.room_for(records, motifs).collect()}
    want = dict.fromkeys(texts, 0)
    for _, n, _, code, _ in rows:
        held = sorted((sum(code[min(x, y) - 1][abs(x - y)] in "ct" for y in range(1, n + 1) if y != x) for x in range(1, n + 1)), reverse=True)
        for m in motifs:
            asked = C.bonds_asked(m)
            want[m.motif_id] += all(i < n and held[i] >= d for i, d in enumerate(asked))
    assert got == want and want["free"] == len(rows) > want["star"] > 0
    hits = {r["query_id"]: r["records"] for r in sweep(records, motifs).groupBy("query_id").agg(F.countDistinct("record_id").alias("records")).collect()}
    assert all(n <= got[q] for q, n in hits.items())


def test_crowded_motifs_are_the_whole_corpus(spark):
    """Every skeleton with every typing, all orders of the grids' points among them, against bonds counted by hand."""
    got = {r["query_id"]: (r["crowded"], r["records"]) for r in enumeration.crowded_motifs(spark, SF).collect()}
    motifs = C.corpus_motifs(spark, 5)
    assert len(got) == len(motifs) == 6336 and enumeration._corpus_of(5) == motifs
    found = {r["nth"]: L.canonical(L.points_of(r["frame"])) for r in L.skeletons(spark, 5).collect()}
    seen = {found[int(q.split("-")[1])] for q in got}
    assert all(L.canonical(p) in seen for points in L.GRID_POINTS.values() for p in itertools.permutations(points) if L.compact(p))
    bonds: dict = {r["record_id"]: {} for r in X.topological(spark, SF).select("record_id").collect()}
    for r in X.contacts_of(X.topological(spark, SF)).where("code IN ('c', 't')").collect():
        for p in (r["i"], r["j"]):
            bonds[r["record_id"]][p] = bonds[r["record_id"]].get(p, 0) + 1
    held = [sorted(own.values(), reverse=True) for own in bonds.values()]
    room = {asked: sum(len(own) >= len(asked) and all(x >= y for x, y in zip(own, asked)) for own in held) for asked in {tuple(C.bonds_asked(m)) for m in motifs}}
    assert got == {m.motif_id: (C.crowded(m), room[tuple(C.bonds_asked(m))]) for m in motifs}
    assert room[()] == len(held) > max(n for asked, n in room.items() if asked)


def test_motif_files(spark, tmp_path):
    texts = {"one": "1 2\nE E\n* x\n*", "two": "1 2\nH E\n* T\n*"}
    for name, text in texts.items():
        (tmp_path / f"{name}.query").write_text(text)
    (tmp_path / "all.txt").write_text("\n".join(str(tmp_path / f"{n}.query") for n in texts))
    assert [m.motif_id for m in read_motifs(spark, str(tmp_path / "all.txt"))] == ["one", "two"]
    assert read_motifs(spark, str(tmp_path / "two.query")) == [parse_motif("two", texts["two"])]
    (tmp_path / "bad.txt").write_text(f"{tmp_path}/one.query\n{tmp_path}/gone.query")
    for path in ("bad.txt", "nowhere.txt"):
        with pytest.raises(MotifError):
            read_motifs(spark, str(tmp_path / path))


def test_listings():
    text = "[3-1-0]\n[7-0]\n1 2 3\nE E H\n* t X\n  * C\n    *\nsS 1 2\nhand 1 2 3 R\n\n[3-2-0]\nbroken\n\n[3-3-1]\n[0-2]\n1 2 3\nH H H\n* u X\n* v\n*\n"
    found = list(listed_motifs(text))
    assert [m.motif_id for m in found] == ["3-1-0-7-0", "3-3-1-0-2"]
    assert found[0].handedness == ((1, 2, 3, "R"),) and found[0].codes == {(1, 2): "t", (1, 3): "X", (2, 3): "C"}
    assert listed_motif(text, "3-3-1-0") == found[1]
    with pytest.raises(KeyError):
        listed_motif(text, "3-2-0-0")


def test_archive(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "r1", 1), ("q1", "r1", 2), ("q2", "r3", 1)], "query_id string, record_id string, motif_idx int")
    assert archive.write_archive(hits, str(tmp_path / "a"), 4) == 3
    assert {tuple(r) for r in archive.query_counts(spark, str(tmp_path / "a")).collect()} == {("q1", 1, 2), ("q2", 1, 1)}
    assert archive.distinct_hitters(spark, str(tmp_path / "a")).count() == 2
    wanted = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    assert [r[0] for r in archive.missing(wanted, hits).collect()] == ["q3"]


def test_lines_over_splits(spark, tmp_path):
    element = ("E", "A", "1", "9", 9, 1.0, 2.0, 3.0, -4.5, 5.25, 6.125)
    schema = "record_id string, n int, elements array<struct<etype:string,chain:string,begin_label:string,end_label:string,length:int,fx:double,fy:double,fz:double,lx:double,ly:double,lz:double>>, sheets array<array<int>>, rows array<string>"
    records = spark.createDataFrame([(f"r{i}", 2, [element, element], [[1, 2]], ["*t", "*"]) for i in range(60)], schema)
    metamatrix.write(records, str(tmp_path / "db"), 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = metamatrix.read_lines(spark, str(tmp_path / "db"))
        assert lines.select("block").distinct().count() > 5
        assert sorted(r["record_id"] for r in metamatrix.parse(lines).collect()) == sorted(f"r{i}" for i in range(60))
        assert metamatrix.parse(metamatrix.clean(lines)).count() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
