"""Operators 11 to 13 against plain versions; nulls, empties, long values, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlattice.llm import registry
from foldlattice.llm.conversation_repair import damage, repair_conversations
from foldlattice.llm.vector_codes import books_digest, compress_vectors, kd_tree, nearest
from foldlattice.llm.warc import archive, file_records, page_records, read_files, reconstruct, write_files

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


# 11 vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label), sound and of one length."""
    rows = sorted(((i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[list(cut[k][p]) for k in range(min(entries, sum(r[0] is not None for r in rows)))] for p in range(parts)]

    def find(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for c in cut:
                met.setdefault(find(c[p], books[p])[1], []).append(c[p])
            for k, own in met.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[find(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(rows, errors):
        labels[label] = labels.get(label, 0) + e
    return sorted((((i is None, i or 0), label, [k for _, k in f], e, labels[label]) for (i, _, label), f, e in zip(rows, found, errors)), key=repr), books


def coded(df, **how):
    out, books = compress_vectors(df, **how)
    return sorted((((r["vec_id"] is None, r["vec_id"] or 0), r["label"], r["codes"], r["error"], r["label_error"]) for r in out.collect()), key=repr), [b.tolist() for b in books]


def test_nearest_keeps_lower_indexes():
    rng = np.random.default_rng(5)
    for n, width, spread in ((1, 1, 3), (9, 1, 2), (64, 4, 2), (64, 4, 300), (200, 3, 4), (40, 2, 1)):
        book, points = rng.integers(-spread, spread, (n, width)), rng.integers(-spread - 2, spread + 2, (500, width))
        index, d = nearest(kd_tree(book), book, points)
        away = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == away.argmin(axis=1)).all() and (d == away.min(axis=1)).all()


def test_codes(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.26, 0.5, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(7, rows[3][1], 1), (None, rows[5][1], 2), (200, [1e-9] * 8, None), (3, [0.125] * 8, 1)]
    odd = [(300, None, 1), (301, [], 1), (302, [0.1] * 7 + [None], 1), (303, [0.1] * 7 + [INF], 1), (304, [NAN] * 8, 1), (305, [0.5] * 4, 1), (306, [0.5] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, v string, codes string").repartition(5)
    for entries in (16, 3, 400):
        want, books = plain_codes(rows, 4, entries, 2, 256)
        assert coded(df, parts=4, entries=entries) == (want, books)
    assert coded(df.limit(0)) == ([], [])
    assert coded(df.where("vec_id is null"), parts=4)[0] == []
    named = df.select("vec_id", F.col("embedding").alias("a.b"), F.col("label").alias("vec id"))
    assert coded(named, parts=4, entries=3, vector_col="a.b", label_col="vec id") == (plain_codes(rows, 4, 3, 2, 256)[0], plain_codes(rows, 4, 3, 2, 256)[1])


def test_large_components(spark):
    df = spark.createDataFrame([(i, [1e300 * (-1) ** i] * 16, 1) for i in range(3)], "vec_id long, embedding array<double>, label int")
    out = coded(df)[0]
    assert [r[2][0] for r in out] == [0, 1, 0] and all(r[3] == 0 for r in out)


def test_books_digest():
    assert books_digest([np.array([[1, -2]]), np.array([[3, 4]])]) == hashlib.sha256(b"1,-2,3,4").hexdigest()


# 12 WARC


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", f"<p>{rng.randrange(40)}é\r\n\r\nWARC/1.1\r\n</p>") for i in range(200)]
    rows += [(i, None, None) for i in range(200, 206)] + [(206, "http://y\r\nA: b", ""), (7, "http://x/7", rows[7][2]), (7, "http://x/7", rows[7][2]), (None, "http://n", rows[9][2]), (None, "http://n", "only here")]
    rows += [(1000 + i, f"http://hot/{i}", "hot" * 50) for i in range(3000)] + [(9999, "http://long", "longword " * 400_000)]
    return rows, spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(4)


def plain_archive(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            response = k == len(ids) - 1 or len(data) < least
            out.append((i, len(data), digest, "response" if response else "revisit", None if response else ids[-1]))
    return sorted(out, key=repr)


def told(read):
    return sorted((tuple(r) for r in read.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_archive(pages):
    rows, df = pages
    for least in (0, 10):
        headers, payloads = archive(page_records(df), least)
        assert told(reconstruct(headers, payloads)) == plain_archive(rows, least)
        assert payloads.count() == len({r[2] or "" for r in rows})
    assert archive(page_records(df.limit(0)))[0].count() == 0


def test_files_and_back(spark, pages, tmp_path):
    rows, df = pages
    whole = reconstruct(*archive(page_records(df)))
    write_files(whole.select("record"), f"{tmp_path}/warc")
    read = read_files(spark, f"{tmp_path}/warc")
    assert read.count() == len(rows)
    first = sorted(bytes(r["record"]) for r in whole.select("record").collect())
    assert sorted(bytes(r["header"]) + bytes(r["block"]) + b"\r\n\r\n" for r in read.collect()) == first
    # records that bring their headers come back to the byte, and their types with them
    again = reconstruct(*archive(file_records(read)))
    assert sorted(bytes(r["record"]) for r in again.select("record").collect()) == first
    kinds = lambda d: sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"])) for r in d.select("record_id", "record_type", "refers_to").collect())
    assert kinds(again) == kinds(whole)


def test_changed_payload_is_noticed(pages):
    headers, payloads = archive(page_records(pages[1].limit(50)))
    with pytest.raises(Exception, match="not what its address says"):
        reconstruct(headers, payloads.withColumn("payload", F.lit(b"else"))).select("payload_digest").collect()


# 13 conversations


LEGAL = {("", "s"), ("s", "u"), ("u", "a"), ("a", "u")}


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    n, targets = len(rows), [""] + [s + "ua" * k for k in range(1, len(rows) + 2) for s in ("", "s")]
    best = None
    for target in targets:
        table = {(n, len(target)): (0, "")}
        for i in range(n, -1, -1):
            for j in range(len(target), -1, -1):
                options = [table[n, len(target)]] if (i, j) == (n, len(target)) else []
                stays = i < n and j < len(target) and faults[i] not in ("blank", "duplicate")
                more = 5 if i < n and faults[i] == "truncated" else 0
                for ok, letter, cost, to in (
                    (i < n, "D", 2, (i + 1, j)),
                    (stays and rows[i][1][:1] == target[j : j + 1], "K", more, (i + 1, j + 1)),
                    (stays and target[j : j + 1] in ("u", "a"), "R", 1 + more, (i + 1, j + 1)),
                    (j < len(target) and target[j : j + 1] in ("u", "a"), "I", 5, (i, j + 1)),
                ):
                    if ok and to in table:
                        c, audit = table[to]
                        options.append((c + cost, letter + audit))
                if options:
                    table[i, j] = min(options)
        if (0, 0) in table:
            best = min(best or (table[0, 0], target), (table[0, 0], target))
    (cost, audit), target = best if rows else ((0, ""), "")
    out, i = [], 0
    for letter in audit:
        if letter in "KR":
            out.append((rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[target[len(out)]], rows[i][2]))
        elif letter == "I":
            out.append(({"u": "user", "a": "assistant"}[target[len(out)]], ""))
        i += letter != "I"
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out)


def told_repairs(df, **how):
    return {r["conv_id"]: (*r[1:8], [tuple(t) for t in r["repaired"]]) for r in repair_conversations(df, **how).collect()}


def test_repairs(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(8)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "usher"]), rng.choice(["Yes.", "No!", "cut", "  \t", "", "Why? \n", f"t{turn}.", "é.", "\0."])))
    rows += [(None, 1, "user", "Null id."), (None, 2, "assistant", "Yes.")] + [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, g string, i string").repartition(4)
    want = {}
    for conv in {r[0] for r in rows if r[0] != 500}:
        want[conv] = plain_repair([r[1:] for r in rows if r[0] == conv])
    got = told_repairs(df)
    long = got.pop(500)
    assert got == want
    assert long[5:7] == (0, "K" * 700) and len(long[7]) == 700
    assert told_repairs(df.limit(0)) == {}


def test_repair_without_rows_or_texts(spark):
    df = spark.createDataFrame([(1, 1, "user", "Here."), (2, 1, "user", "Gone."), (3, None, None, None), (3, 5, "system", "Sys.")], "`a.b` long, turn long, role string, text string")
    got = told_repairs(df, conv_col="a.b", present=~F.col("text").eqNullSafe("Gone."))
    assert got[1] == (0, 0, 0, 0, 0, 2, "D", [])
    assert got[2] == (0, 0, 0, 0, 0, 0, "", [])
    assert got[3] == plain_repair([(None, "", ""), (5, "system", "Sys.")])[:-1] + ([],)


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "system", "A. b!"), (1, "assistant", "C?"), (None, None, None))] + [(None, 1, "user", "x.")]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        hurt = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if hurt == 1 else text.translate(str.maketrans("", "", ".!?")) if hurt == 2 else text
        want += [(c, t, "user" if hurt == 4 else role, text, hurt != 0)] * (2 if hurt == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in damage(df).collect()), key=repr) == sorted(want, key=repr)


def test_long_text(spark):
    text = "word " * 600_000 + "end."
    df = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", text), (2, 1, "user", text)], "conv_id long, turn long, role string, text string")
    got = told_repairs(df)
    assert got[1][6] == "KK" and got[1][7][0] == ("user", text) and got[2][6] == "D"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_warc_archive", "op13_conversation_repair"])
def test_queries_on_tables(spark, name):
    """The SQL twin runs in the driver's comparison; here the query's columns and whole tables."""
    table = {"op11_vector_codes": "embeddings", "op12_warc_archive": "pages", "op13_conversation_repair": "conversations"}[name]
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    out = registry.queries()[name](spark, SF)
    assert out.count() == (source.select("conv_id").distinct().count() if table == "conversations" else source.count())
