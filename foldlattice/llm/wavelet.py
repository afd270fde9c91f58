"""Token shards as wavelet matrices: one compressed file a shard, read by access, rank and select.

A shard holds the ids of consecutive documents.  Its file has one bit-plane for each bit of the
largest id, highest first; in each next plane the sequence is stably parted by the bit before.
Beside each plane stand the counts of ones up to every 512th bit.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, shared_folder
from foldlattice.llm.encoding import library_encoder, texts_in

BLOCK = 512
#: Tokens that are put in their places at once.
DECODED = 1 << 17
#: Characters of text that a shard is planned for, and tokens at which a shard is closed.
SHARD_CHARS = 8_000_000
SHARD_TOKENS = 4_000_000
#: ``shard`` is the writing task, whose ids follow those of the task before, and ``place`` counts its shards.
SHARD_SCHEMA = "shard long, place long, n_docs long, n_tokens long, doc_ids binary, lengths binary, width int, zeros array<long>, planes array<binary>, ranks array<binary>"


@dataclass
class WaveletMatrix:
    """``planes`` are packed bits (big-endian in a byte), ``ranks`` ones before each block."""

    n: int
    zeros: list[int]
    planes: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        out = cls(len(ids), [], [], [])
        for level in range(width - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << level)) != 0
            plane = np.packbits(bits)
            blocks = np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)
            ones = np.bitwise_count(blocks).sum(axis=1, dtype=np.uint32)
            zeros = len(ids) - int(np.count_nonzero(bits))
            parted = np.empty_like(ids)
            np.compress(~bits, ids, out=parted[:zeros])
            np.compress(bits, ids, out=parted[zeros:])
            out.zeros.append(zeros)
            out.planes.append(plane)
            out.ranks.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32) if len(ones) else ones)
            ids = parted
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block = i // BLOCK
        own = self.planes[level][block * BLOCK // 8 : (i + 7) >> 3]
        whole = int(np.bitwise_count(own).sum())
        if i & 7:
            whole -= (int(own[-1]) & (0xFF >> (i & 7))).bit_count()
        return int(self.ranks[level][block]) + whole

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, begin), self._ones(level, end)
            if token >> (len(self.zeros) - 1 - level) & 1:
                begin, end = zeros + ones[0], zeros + ones[1]
            else:
                begin, end = begin - ones[0], end - ones[1]
        return begin, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before place ``end``."""
        return self.count(token, 0, end)

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        if token < 0 or token >> len(self.zeros):
            return 0
        b, e = self._range(token, begin, self.n if end is None else min(end, self.n))
        return e - b

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        own = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError("no such occurrence")
        at = self._range(token, 0, self.n)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        ids = np.zeros(self.n, dtype=np.uint32 if len(self.zeros) > 16 else np.uint16)
        for k in range(len(self.zeros) - 1, -1, -1):
            bits = np.unpackbits(self.planes[k], count=self.n).view(bool)
            ids[self.zeros[k] :] |= ids.dtype.type(1 << (len(self.zeros) - 1 - k))
            above, at = np.empty_like(ids), [0, self.zeros[k]]
            # by places and in runs that a cache holds: masks of mixed bits are several times slower
            for begin in range(0, self.n, DECODED):
                own = bits[begin : begin + DECODED]
                for bit, places in enumerate((np.flatnonzero(~own), np.flatnonzero(own))):
                    above[begin : begin + DECODED][places] = ids[at[bit] : at[bit] + len(places)]
                    at[bit] += len(places)
            ids = above
        return ids


def open_shard(row: dict) -> WaveletMatrix:
    """The matrix of one shard row."""
    return WaveletMatrix(row["n_tokens"], list(row["zeros"]), [np.frombuffer(p, dtype=np.uint8) for p in row["planes"]], [np.frombuffer(r, dtype=np.uint32) for r in row["ranks"]])


def write_shards(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts, ``end_id`` behind each, and write shards in ascending id order under ``path``.

    Documents are dealt out by ranges of their ids, so that shard k's ids all precede shard k + 1's.
    A shard is closed at ``tokens`` or more, so a very long text makes one larger shard.  A null text is empty; an empty table writes no shard.  Rows
    without an id are left out; rows that share one are each written, next to each other.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    end = np.array([end_id], dtype="<u4").tobytes()

    def shard(task: int, place: int, ids: list[int], packed: list[bytes], width: int) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(packed), dtype="<u4")
        m = WaveletMatrix.build(tokens.astype(np.uint16) if width <= 16 else tokens, width)
        one = {
            "shard": task, "place": place, "n_docs": len(ids), "n_tokens": m.n, "doc_ids": np.array(ids, dtype="<i8").tobytes(), "lengths": np.array([len(p) // 4 for p in packed], dtype="<i8").tobytes(),
            "width": width, "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks],
        }
        types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), types)], list(one))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        width = max(encoder.top_id, end_id).bit_length()
        task, place = TaskContext.get().partitionId(), 0
        ids, packed, held = [], [], 0
        for batch in batches:
            for own_ids, texts in texts_in(batch):
                for i, p in zip(own_ids, encoder.packed_many(texts)):
                    ids.append(i)
                    packed.append(p + end)
                    held += len(p) // 4 + 1
                    if held >= tokens:
                        yield shard(task, place, ids, packed, width)
                        ids, packed, held, place = [], [], 0, place + 1
        if ids:
            yield shard(task, place, ids, packed, width)

    n = max(1, -(-chars // SHARD_CHARS))
    own.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").transform(in_arrow, work, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_documents(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` (little-endian 32-bit) read back from shard files."""
    kept = ["shard", "place", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: 6 + with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = open_shard(row).decode().astype("<u4").tobytes()
                ids, lengths = np.frombuffer(row["doc_ids"], dtype="<i8"), np.frombuffer(row["lengths"], dtype="<i8")
                ends = np.cumsum(lengths)
                for part in np.array_split(np.arange(len(ids)), len(tokens) // 8_000_000 + 1):
                    own = [tokens[4 * b : 4 * e] for b, e in zip(ends[part] - lengths[part], ends[part])]
                    cols = [pa.array(np.full(len(part), row["shard"])), pa.array(np.full(len(part), row["place"])), pa.array(ids[part]), pa.array(ends[part] - lengths[part]), pa.array(lengths[part]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary())][: len(kept)], kept)

    # one row a shard meets here, not its tokens
    offsets = shards.select("shard", "place", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard", "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    decoded = shards.transform(in_arrow, work, f"shard long, place long, doc_id long, within long, n_tokens long, ids_crc32 long{', ids binary' * with_ids}")
    return decoded.join(offsets, ["shard", "place"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), *kept[4:])


def new_shard_folder(docs: DataFrame) -> str:
    return f"{shared_folder(docs.sparkSession)}/shards/{uuid.uuid4().hex}"
