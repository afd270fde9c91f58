"""Record text as a Spark data source: ``spark.read.format("foldrecords").load(path)``.

Files are cut into splits by bytes.  A record belongs to the split in which its header begins, so a
split's reader goes on behind its end until the next header.  Filters on ``record_id`` (equal, in) and
on ``n`` (at least, more than, equal) are met by headers alone; the rest of such records isn't parsed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from foldlattice.sources.metamatrix import COUNT_AT, ELEMENT_WIDTH, ELEMENTS_AT, ID_WIDTH, POINTS

NAME = "foldrecords"
SCHEMA = "record_id string, n int, elements array<struct<etype:string,chain:string,begin_label:string,end_label:string,length:int,fx:double,fy:double,fz:double,lx:double,ly:double,lz:double>>, sheets array<array<int>>, rows array<string>"
ELEMENT = pa.struct([(c, pa.string()) for c in ("etype", "chain", "begin_label", "end_label")] + [("length", pa.int32())] + [(c, pa.float64()) for c in POINTS])
ARROW = pa.schema([("record_id", pa.string()), ("n", pa.int32()), ("elements", pa.list_(ELEMENT)), ("sheets", pa.list_(pa.list_(pa.int32()))), ("rows", pa.list_(pa.string()))])
BATCH = 500


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


def _number(text: str, kind=float):
    try:
        return kind(text)
    except ValueError:
        return None


def _is_header(line: str) -> bool:
    return bool(line.strip()) and not line.startswith("sheet ") and ".ssd" in line[:ID_WIDTH]


def parse_record(header: str, n: int, lines: list[str]) -> dict | None:
    """A record of a header that fits its count and the lines behind it; none without a matrix."""
    matrix = next((x for x in lines if x.startswith("*")), None)
    if matrix is None:
        return None
    elements = []
    for at in range(ELEMENTS_AT - 1, ELEMENTS_AT - 1 + ELEMENT_WIDTH * n, ELEMENT_WIDTH):
        e = header[at : at + ELEMENT_WIDTH]
        points = {p: _number(e[20 + 8 * k : 28 + 8 * k]) for k, p in enumerate(POINTS)}
        elements.append({"etype": e[0], "chain": e[1], "begin_label": e[2:7].strip(), "end_label": e[9:14].strip(), "length": _number(e[15:19], int), **points})
    sheets = [[int(x[12 + 6 * k : 18 + 6 * k]) for k in range(1, int(x[12:18]) + 1)] for x in lines if x.startswith("sheet ") and len(x) >= 24]
    return {"record_id": header[:ID_WIDTH].rpartition(".ssd")[0], "n": n, "elements": elements, "sheets": sheets, "rows": [f"*{r}" for r in matrix.split("*")[1 : n + 1]]}


class RecordReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.ids: set[str] | None = None
        self.least = 0
        self.skipped = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("record_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = own if self.ids is None else self.ids & own
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("n",):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        kept = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        scheme = self.path.partition("://")[0]
        return [Split(f"{scheme}://{f.path}", b, min(b + self.split, f.size)) for f in sorted(kept, key=lambda f: f.path) for b in range(0, f.size, self.split)]

    def wanted(self, header: str) -> int | None:
        """The element count of a sound header that the filters let pass."""
        n = _number(header[COUNT_AT - 1 : COUNT_AT + 3], int)
        if n is None or n < 1 or len(header) != ELEMENTS_AT - 1 + ELEMENT_WIDTH * n:
            return None
        if n < self.least or self.ids is not None and header[:ID_WIDTH].rpartition(".ssd")[0] not in self.ids:
            self.skipped += 1
            return None
        return n

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(part.path)
        rows: list[dict] = []
        with store.open_input_file(path) as file:
            text = io.BufferedReader(file, 1 << 20)
            at = max(part.begin - 1, 0)
            text.seek(at)
            if part.begin:  # the line that a split begins within is the one before's
                at += len(text.readline())
            header, n, lines = "", None, []
            for raw in text:
                line = raw.decode("utf-8", "replace").rstrip("\r\n")
                begins = _is_header(line)
                if begins and at >= part.end:
                    break
                at += len(raw)
                if begins:
                    if n and (made := parse_record(header, n, lines)):
                        rows.append(made)
                    header, n, lines = line, self.wanted(line), []
                elif n:
                    lines.append(line)
                elif at >= part.end and not header:
                    break
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            if n and (made := parse_record(header, n, lines)):
                rows.append(made)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class RecordText(DataSource):
    """Options: ``path`` (with a scheme that pyarrow knows) and ``split``, bytes a task reads (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("split", 64 << 20)))


def read_records(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Records under ``path`` through the data source, filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordText)
    return spark.read.format(NAME).option("split", split).load(path if "://" in path else f"file://{path}")
