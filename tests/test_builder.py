"""Card text and the element builder against small worked cases."""

import numpy as np
import pytest

from foldlattice.operators import builder as B
from foldlattice.sources import hit_text, metamatrix, ssd


def card(line, **at):
    out = list(line.ljust(80))
    for place, text in at.values():
        out[place - 1 : place - 1 + len(text)] = text
    return "".join(out)


def atom(kind, name, chain, label, x, y, z):
    return card(kind, a=(13, f" {name} "), b=(22, chain), c=(23, f"{label:>4} "), d=(31, f"{x:8.3f}{y:8.3f}{z:8.3f}"))


@pytest.fixture(scope="module")
def lines(spark):
    text = [
        card("HELIX", a=(20, "A"), b=(22, "   1 "), c=(34, "   6 "), d=(72, "    6")),
        card("SHEET", a=(12, " S1"), b=(22, "A"), c=(23, "   8 "), d=(34, "  10 "), e=(72, "    3")),
        card("SHEET", a=(12, " S1"), b=(22, "A"), c=(23, "  12 "), d=(34, "  14 "), e=(71, "m"), f=(72, "    3")),
        card("LINKER", a=(20, "A"), b=(22, "   6 "), c=(32, "A"), d=(34, "   8 "), e=(72, "    3")),
        card("LINKER", a=(20, "A"), b=(22, "   6 "), c=(32, "B"), d=(34, "   8 "), e=(72, "    3")),
        card("PAIRS", a=(8, "  1"), b=(20, "A"), c=(22, "   8 "), d=(32, "A"), e=(34, "  14 ")),
        card("PAIRS", a=(8, "  1000"), b=(21, "A"), c=(23, "  10 "), d=(33, "A"), e=(35, "  12 ")),
        *[atom("ATOM  ", "CA", "A", i, i, 2 * i, 0) for i in range(1, 4)],
        atom("ATOM  ", "CB", "A", 3, 9, 9, 9),
        atom("HETATM", "CA", "A", 3, 8, 8, 8),
        atom("HETATM", "CA", "A", 4, 4, 8, 0),
        "ENDMDL",
        atom("ATOM  ", "CA", "A", 5, 5, 5, 5),
    ]
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, at int, line string")


def test_cards(lines):
    got = [(r["idx"], r["label"].strip(), r["x"], r["y"]) for r in ssd.residues(lines).orderBy("idx").collect()]
    assert got == [(2, "1", 1.0, 2.0), (3, "2", 2.0, 4.0), (4, "3", 3.0, 6.0), (5, "4", 4.0, 8.0)]
    got = {(r["etype"], r["begin_label"].strip(), r["end_label"].strip(), r["length"], r["sheet"], r["excluded"]) for r in ssd.elements(lines).collect()}
    assert got == {("H", "1", "6", 6, None, False), ("E", "8", "10", 3, "S1", False), ("E", "12", "14", 3, "S1", True), ("L", "6", "8", 3, None, False)}
    got = {(r["a_label"].strip(), r["b_label"].strip()) for r in ssd.bonds(lines).collect()}
    assert got == {("8", "14"), ("14", "8"), ("10", "12"), ("12", "10")}


def test_helix_axis():
    t = np.arange(12) * np.radians(100)
    points = np.stack([2.3 * np.cos(t), 2.3 * np.sin(t), 1.5 * np.arange(12)], axis=1)
    first, last = B.helix_axis(points)[:3], B.helix_axis(points)[3:]
    direction = (last - first) / np.linalg.norm(last - first)
    assert direction == pytest.approx([0, 0, 1], abs=1e-6) and np.linalg.norm(last - first) == pytest.approx(16.5, abs=1e-6)
    assert B.helix_axis(points[:3]) is None


def _plain_record(text):
    """The record of one file's lines, step by step."""
    atoms, cards, pairs = {}, [], []
    for at, line in enumerate(text):
        if line.startswith("ENDMDL"):
            break
        if line[:4] == "ATOM" and line[12:16].strip() == "CA":
            atoms.setdefault((line[21], line[22:27].strip()), np.array([float(line[30 + 8 * k : 38 + 8 * k]) for k in range(3)]))
    index = {k: n + 2 for n, k in enumerate(atoms)}
    for at, line in enumerate(text):
        spots = {"HELIX": (19, 21, "H"), "SHEET": (21, 22, "E"), "LINKE": (19, 21, "L")}.get(line[:5])
        if spots:
            chain, begin, kind = spots
            if kind == "L" and line[19] != line[31]:
                continue
            ends = [index.get((line[chain], line[k : k + 5].strip())) for k in (begin, 33)]
            if None not in ends:
                cards.append({"at": at, "kind": kind, "chain": line[chain], "ends": ends, "length": int(line[71:76]), "sheet": line[11:14].strip() if kind == "E" else None, "marked": kind == "E" and line[70] == "m"})
        if line.startswith("PAIRS"):
            a, b = index.get((line[19], line[21:26].strip())), index.get((line[31], line[33:38].strip()))
            if a and b:
                pairs += [(a, b), (b, a)]
    marked = [c["ends"] for c in cards if c["marked"]]
    pairs = sorted({p for p in pairs if not any(lo <= x <= hi for lo, hi in marked for x in p)})
    kept = [c for c in cards if c["length"] >= {"H": 5, "E": 2, "L": 3}[c["kind"]]]
    strand = lambda c: int(c["kind"] == "E")
    first = {ch: min((strand(c), c["at"]) for c in kept if c["chain"] == ch) for ch in {c["chain"] for c in kept}}
    kept.sort(key=lambda c: (first[c["chain"]], c["ends"][0], strand(c), c["at"]))
    for c in kept:
        c["held"] = {i: atoms[k] for k, i in index.items() if k[0] == c["chain"] and c["ends"][0] <= i <= c["ends"][1]}
        p = np.array(list(c["held"].values()))
        if c["kind"] == "H":
            c["axis"] = B.helix_axis(p)
        elif len(p) < 2:
            c["axis"] = None
        else:
            k = len(p) // 3 if len(p) > 3 else 1
            a, b = (p[0], p[1]) if len(p) == 2 else ((p[k - 1] + p[k]) / 2, (p[-k - 1] + p[-k]) / 2)
            c["axis"] = np.concatenate([a + (x - a) @ (b - a) / ((b - a) @ (b - a)) * (b - a) for x in (p[0], p[-1])])
    rows = []
    for i, a in enumerate(kept):
        row = "*"
        for b in kept[i + 1 :]:
            own = [p for p in pairs if p[0] in a["held"] and p[1] in b["held"]]
            if strand(a) and strand(b) and len(own) >= 2:
                row += "t" if own[0][1] > own[-1][1] else "c"
            elif strand(a) and strand(b) and a["sheet"] == b["sheet"] or a["axis"] is None or b["axis"] is None:
                row += "-"
            else:
                row += _plain_code(a, b)
        rows.append(row)
    return [c["kind"] for c in kept], rows, [c["axis"] for c in kept]


def _plain_code(a, b):
    f, l, g, m = a["axis"][:3], a["axis"][3:], b["axis"][:3], b["axis"][3:]
    shared = []
    for s, t in (((f + g) / 2, (l + m) / 2), ((f + m) / 2, (l + g) / 2)):
        line = (t - s) / np.linalg.norm(t - s)
        at = [sorted(float((x - s) @ line) for x in pair) for pair in ((f, l), (g, m))]
        shared.append(max(0.0, min(at[0][1], at[1][1]) - max(at[0][0], at[1][0])))
    gap = min(np.linalg.norm(p - q) for p in a["held"].values() for q in b["held"].values())
    turn = np.degrees(np.arccos((l - f) @ (m - g) / np.linalg.norm(l - f) / np.linalg.norm(m - g)))
    return "-" if max(shared) <= 2.5 or gap > 11 else "v" if turn > 95 else "u" if turn < 85 else "N"


def test_whole_records(spark):
    """Structures of two chains and up to 520 residues, built in their rows and step by step."""
    rng = np.random.default_rng(12)
    files = {}
    for f, size in (("small", 60), ("large", 520), ("none", 8)):
        text, walk, labels = [], np.zeros(3), []
        for i in range(size):
            chain = "AB"[i >= size * 2 // 3]
            walk = walk + rng.normal(0, 1.6, 3)
            walk = np.clip(walk, -22, 22)
            labels.append((chain, str(i)))
            text.append(atom("ATOM  ", "CA", chain, i, *walk))
            if i % 9 == 4:
                text += [atom("ATOM  ", "CB", chain, i, *walk), atom("ATOM  ", "CA", chain, i, 9, 9, 9)]
        i = 0
        while i < size - 14 and f != "none":
            n = int(rng.integers(1, 13))
            chain = labels[i][0]
            if labels[i + n - 1][0] == chain:
                kind = ("HELIX", "SHEET", "SHEET", "LINKER")[int(rng.integers(4))]
                ends = (f"{i:>4} ", f"{i + n - 1:>4} ", f"{n:>5}")
                if kind == "SHEET":
                    text.append(card(kind, a=(12, f" S{int(rng.integers(3))}"), b=(22, chain), c=(23, ends[0]), d=(34, ends[1]), e=(71, "m" if rng.random() < 0.1 else " "), f=(72, ends[2])))
                else:
                    text.append(card(kind, a=(20, chain), b=(22, ends[0]), c=(32, chain), d=(34, ends[1]), e=(72, ends[2])))
            i += n + int(rng.integers(3))
        for _ in range(size * 4):
            x, y = (int(v) for v in rng.integers(0, size, 2))
            text.append(card("PAIRS", a=(8, "  1"), b=(20, labels[x][0]), c=(22, f"{x:>4} "), d=(32, labels[y][0]), e=(34, f"{y:>4} ")))
        text += ["ENDMDL", atom("ATOM  ", "CA", "A", 999, 0, 0, 0)]
        files[f] = text
    df = spark.createDataFrame([(f, i, t) for f, text in files.items() for i, t in enumerate(text)], "file string, at int, line string")
    assert B.build_records(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    built = B.build_records(df.repartition(5))
    got = {r["record_id"]: r for r in built.collect()}
    assert set(got) == {"small", "large"}
    letters = set()
    for f, r in got.items():
        kinds, rows, axes = _plain_record(files[f])
        assert [e["etype"] for e in r["elements"]] == kinds and r["n"] == len(kinds) and r["rows"] == rows
        letters |= set("".join(rows))
        for e, a in zip(r["elements"], axes):
            own = [e[f"{x}{c}"] for x in "fl" for c in "xyz"]
            assert own == [None] * 6 if a is None else own == pytest.approx(list(a), abs=1e-6)
    assert letters == set("*-tcuvN")


def test_near_elements(spark):
    """500 residues over both signs of each axis, some at one place, some without one."""
    rng = np.random.default_rng(7)
    rows = [(r, int(p), *map(float, xyz)) for r in (1, 2) for p, xyz in zip(rng.integers(1, 40, 500), rng.normal(0, 45, (500, 3)))]
    rows += [(1, 50, 0.0, 0.0, 0.0), (1, 51, 0.0, 0.0, 0.0), (1, 52, 11.0, 0.0, 0.0), (1, 53, None, 1.0, 1.0)]
    got = {(r["record_id"], r["i"], r["j"]): r["gap"] for r in B.near_elements(spark.createDataFrame(rows, "record_id int, pos int, x double, y double, z double")).collect()}
    want = {}
    for r in (1, 2):
        own = [(p, np.array(xyz)) for k, p, *xyz in rows if k == r and None not in xyz]
        for p, a in own:
            for q, b in own:
                if p < q and (d := float(np.linalg.norm(a - b))) <= 11:
                    want[r, p, q] = min(d, want.get((r, p, q), 99.0))
    assert got == pytest.approx(want) and got[1, 50, 52] == 11.0 and len(got) > 100


def test_strand_bonds(spark):
    held = spark.createDataFrame([(1, p, "E", i, 0.0, 0.0, 0.0) for p, r in ((1, range(1, 6)), (2, range(11, 16))) for i in r], "record_id int, pos int, etype string, idx int, x double, y double, z double")
    up = spark.createDataFrame([(1, 1, 11), (1, 3, 13), (1, 11, 1), (1, 13, 3)], "record_id int, a int, b int")
    down = spark.createDataFrame([(1, 1, 15), (1, 3, 13), (1, 5, 11)], "record_id int, a int, b int")
    assert [tuple(r) for r in B.strand_bonds(held, up).collect()] == [(1, 1, 2, 2, "c")]
    assert [tuple(r) for r in B.strand_bonds(held, down).collect()] == [(1, 1, 2, 3, "t")]
    assert B.strand_bonds(held, up.limit(1)).count() == 0


def test_hit_text(spark):
    segment = "array<struct<etype:string,pos:int,begin:string,end:string,chain:string,length:int>>"
    hits = spark.createDataFrame([("q", "r1", 1, [("E", 3, "12A", "-4", "A", 7), ("H", 9, "100", "111", "B", 12)]), ("q", "r1", 2, [("L", 4, "1", "2", "A", 2)])], f"query_id string, record_id string, motif_idx int, segments {segment}")
    assert sorted(hit_text.parse(hit_text.render(hits)).collect()) == sorted(hits.collect())


def test_record_files(spark, tmp_path):
    element = ("E", "A", "1", "9", 9, 1.0, 2.0, 3.0, -4.5, 5.25, 6.125)
    schema = "record_id string, n int, elements array<struct<etype:string,chain:string,begin_label:string,end_label:string,length:int,fx:double,fy:double,fz:double,lx:double,ly:double,lz:double>>, sheets array<array<int>>, rows array<string>"
    records = spark.createDataFrame([(f"r{i}", 2, [element, element], [[1, 2]] if i % 2 else [], ["*t", "*"]) for i in range(9)], schema)
    metamatrix.write(records, str(tmp_path / "db"), 3)
    back = metamatrix.parse(metamatrix.read_lines(spark, str(tmp_path / "db"))).select(records.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect()))
