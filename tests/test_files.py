"""The record data source, resumable archives and completeness of reports."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from foldlattice.sources import archive, metamatrix
from foldlattice.sources.record_source import RecordReader, read_records
from foldlattice.streaming.completeness import completed_by_files, completed_queries
from foldlattice.streaming.sweep import write_dealt

SCHEMA = "record_id string, n int, elements array<struct<etype:string,chain:string,begin_label:string,end_label:string,length:int,fx:double,fy:double,fz:double,lx:double,ly:double,lz:double>>, sheets array<array<int>>, rows array<string>"


def _records(count):
    rng = random.Random(count)
    out = []
    for i in range(count):
        n = rng.randrange(1, 7)
        element = lambda: (rng.choice("HEL"), "A", str(rng.randrange(99)), "9", rng.randrange(99), *[round(rng.uniform(-9, 9), 3) for _ in range(6)])
        sheets = [sorted(rng.sample(range(1, n + 1), 2))] if n > 2 and i % 2 else []
        out.append((f"r{i}", n, [element() for _ in range(n)], sheets, ["*" + "".join(rng.choice("ctuvN-") for _ in range(n - k)) for k in range(1, n + 1)]))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two files of records with damage between them: a header without a matrix, one too long, stray and blank lines."""
    path = tmp_path_factory.mktemp("records")
    lines = metamatrix.render(spark.createDataFrame(_records(60), SCHEMA)).orderBy("record_id", "place").collect()
    text = []
    for r in lines:
        text.append(r["line"])
        if r["line"].startswith("*"):
            text += [["?? stray"], [""], ["lost.ssd".ljust(32) + "   1" + "x" * 68], ["long.ssd".ljust(32) + "   1" + "x" * 69, "*"], []][len(text) % 5]
    half = next(i for i in range(len(text) // 2, len(text)) if ".ssd" in text[i][:32])
    (path / "one.txt").write_text("?? before\n*c\n" + "\n".join(text[:half]) + "\n")
    (path / "two.txt").write_text("\n".join(text[half:]))
    return str(path)


def test_record_source(spark, folder):
    want = sorted(map(str, metamatrix.parse(metamatrix.read_lines(spark, folder)).select("record_id", "n", "elements", "sheets", "rows").collect()))
    assert len(want) == 60
    for split in (7, 100, 999, 10_000, 64 << 20):
        got = read_records(spark, folder, split)
        assert sorted(map(str, got.collect())) == want
    assert read_records(spark, folder, 500).rdd.getNumPartitions() > 10
    assert read_records(spark, f"{folder}/one.txt").count() < 60


def test_record_source_filters(spark, folder):
    rows = {r[0]: r[1] for r in _records(60)}
    some = read_records(spark, folder, 500).where("n >= 5 AND record_id IN ('r1', 'r2', 'r3', 'r4', 'r5', 'r6', 'r7')")
    assert {r["record_id"] for r in some.collect()} == {f"r{i}" for i in range(1, 8) if rows[f"r{i}"] >= 5}
    assert read_records(spark, folder).where("record_id = 'r9'").count() == 1
    assert read_records(spark, folder).where("n > 6").count() == 0
    # the reader itself: what it takes, and records that it leaves unparsed
    reader = RecordReader(f"file://{folder}", 500)
    assert list(reader.pushFilters([EqualTo(("record_id",), "r9"), IsNotNull(("record_id",)), In(("record_id",), ("r9", "r10")), GreaterThanOrEqual(("n",), 1)])) == [IsNotNull(("record_id",))]
    held = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in held] == ["r9"] and reader.skipped == 59


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk int, record_id int")


def _codes(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk int, rc int")


def test_resumed_archive(spark, tmp_path):
    path, shards = str(tmp_path / "a"), 2
    names = [f"q{i}" for i in range(6)]
    wanted = archive.wanted_parts(spark.createDataFrame([(n,) for n in names], "query_id string"), 3)
    assert wanted.count() == 18
    whole = [(n, c, 100 * i + c) for i, n in enumerate(names) for c in range(3) if (i + c) % 2]
    bad = {("q1", 0), ("q4", 2)}
    first = [h for h in whole if h[:2] not in bad] + [("q4", 2, 999)]  # what a failed part left
    archive.write_attempt(_hits(spark, first), _codes(spark, [(n, c, int((n, c) in bad)) for n in names for c in range(3) if (n, c) != ("q5", 1)]), path, shards)
    with pytest.raises(archive.ArchiveError, match="3 parts are missing"):
        archive.finished(spark, path, wanted)
    left = {tuple(r) for r in archive.pending(spark, path, wanted, shards).collect()}
    assert bad | {("q5", 1)} <= left and len(left) < 18
    # an attempt that breaks between hits and ledger leaves rows that nothing counts
    broken = _hits(spark, [(n, c, 7) for n, c in sorted(left)]).withColumns({"shard": archive._shard(shards), "run": F.lit("broken")})
    broken.write.mode("append").partitionBy("shard", "chunk").parquet(f"{path}/hits")
    parts = sorted(left)
    before = archive.ledger(spark, path).where("rc = 0").join(_codes(spark, [(*p, 0) for p in parts]).select("query_id", "chunk"), ["query_id", "chunk"], "left_anti").select("query_id", "chunk", "run").collect()
    archive.write_attempt(_hits(spark, [h for h in whole if h[:2] in left]), _codes(spark, [(*p, 0) for p in parts]), path, shards)
    assert sorted(tuple(r) for r in archive.finished(spark, path, wanted).select("query_id", "chunk", "record_id").collect()) == sorted(whole)
    after = {(r["query_id"], r["chunk"]): r["run"] for r in archive.ledger(spark, path).collect()}
    assert all(after[r["query_id"], r["chunk"]] == r["run"] for r in before) and len(before) == 18 - len(left)
    assert archive.pending(spark, path, wanted, shards).count() == 0
    # rows that go missing later are noticed
    archive.finished(spark, path, wanted).where("false")
    spark.read.parquet(f"{path}/hits").where("query_id <> 'q0'").write.parquet(f"{tmp_path}/b/hits")
    spark.read.parquet(f"{path}/ledger").write.parquet(f"{tmp_path}/b/ledger")
    with pytest.raises(archive.ArchiveError, match="other rows"):
        archive.finished(spark, f"{tmp_path}/b", wanted)


def test_large_unit_is_written_by_several_tasks(spark, tmp_path):
    """One unit's hits pass the size of a part many times over: they are written by several tasks, each row once."""
    hits = spark.range(60_000).select(F.lit("q0").alias("query_id"), F.lit(0).alias("chunk"), F.sha2(F.col("id").cast("string"), 256).alias("record_id"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        archive.write_attempt(hits.repartition(8), _codes(spark, [("q0", 0, 0)]), str(tmp_path), 3)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "hits").rglob("*.parquet"))) > 2
    assert archive.finished(spark, str(tmp_path), archive.wanted_parts(hits, 1)).select("record_id").distinct().count() == 60_000


def test_completed_once(spark, tmp_path):
    """Reports in five batches: failed, late, repeated and foreign chunks; each query is told in the batch of its last chunk."""
    batches = [
        [("a", 0, 0, 5), ("a", 1, 1, 9), ("b", 0, 0, 1), ("c", 9, 0, 1)],
        [("a", 1, 0, 7), ("a", 0, 0, 5), ("b", 2, 0, 1)],
        [("a", 2, 0, 1), ("b", 1, 1, 4), ("c", 0, 0, 2)],
        [("a", 2, 0, 1), ("a", 1, 1, 3), ("b", 1, 0, 4)],
        [("b", 1, 0, 4), ("a", 0, 0, 5)],
    ]
    schema = "query_id string, chunk int, rc int, rows long"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = []

    def keep(frame, epoch):
        out.extend((epoch, *r) for r in frame.collect())

    for i in range(len(batches)):  # one batch a run, state carried by the checkpoint
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{{{','.join(map(str, range(i + 1)))}}}")
        completed_queries(stream, 3).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert out == [(2, "a", 3, 13), (3, "b", 3, 6)]


def test_completed_in_any_order(spark):
    rng = random.Random(2)
    rows = [(q, c, int(rng.random() < 0.3), 10 * c + q) for q in range(20) for c in range(11) for _ in range(2)] + [(99, None, 0, 1)]
    got = completed_by_files(spark.createDataFrame(rows, "query_id int, chunk int, rc int, rows long"), 11, 4).collect()
    done = {q: {c for x, c, rc, _ in rows if x == q and rc == 0} for q in range(20)}
    assert sorted(tuple(r) for r in got) == [(q, 11, sum(10 * c + q for c in range(11))) for q in range(20) if len(done[q]) == 11]


def test_completed_in_buckets(spark, tmp_path):
    """One call and one state take all of a bucket's queries; ids of any kind, null ones together, and rows that are null."""
    rows = [(q, c, 0, None if c == 1 else 7) for q in (None, 1 << 60, (1 << 60) + 1, *range(3_000)) for c in range(9)] + [(5_000, c, 0, 1) for c in range(8)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "query_id long, chunk int, rc int, rows long")
    got = completed_by_files(frame, 9, 5).collect()
    assert {tuple(r) for r in got} == {(q, 9, 56) for q in (None, 1 << 60, (1 << 60) + 1, *range(3_000))} and len(got) == 3_003
    named = completed_by_files(frame.where("query_id < 40 OR query_id >= 5000").withColumn("query_id", F.concat(F.lit("q"), F.col("query_id"))), 9, 5).collect()
    assert sorted(r["query_id"] for r in named) == sorted([f"q{i}" for i in range(40)] + [f"q{1 << 60}", f"q{(1 << 60) + 1}"])
    assert completed_by_files(frame.where("false"), 9, 5).count() == 0
    frame.write.parquet(f"{tmp_path}/in")
    told = completed_queries(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 9).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    told.awaitTermination()
    assert 500 < max(p["stateOperators"][0]["numRowsTotal"] for p in told.recentProgress if p["stateOperators"]) <= 1_025


def test_dealt_files(spark, tmp_path):
    """A task's rows go to all folders, so no file and no reading task holds a fixed part of the whole."""
    rows = spark.range(0, 4_000, numPartitions=8)
    a_batch = write_dealt(rows, f"{tmp_path}/a", 4)
    held = spark.read.schema("id long").parquet(f"{tmp_path}/a")
    assert a_batch == 8 and len(held.inputFiles()) == 32 and held.distinct().count() == 4_000
    assert write_dealt(rows.where("false"), f"{tmp_path}/b", 4) == 0
