"""Best-fit packing of token pieces by exact complements over a histogram of lengths.

How pieces fill sequences depends on how many pieces of each length there are, and a sequence of
``capacity`` tokens has no more lengths than that.  The plan is therefore made on that bounded
histogram; pieces then find their place in the plan by their rank among equals, which Spark
counts in two steps so that a length held by a third of all pieces is no single group.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, stored
from foldlattice.llm.encoding import REMEMBERED, library_encoder, texts_in

CAPACITY = 2048
#: Pieces that one ranking group holds on average at most.
RANK_GROUP = 5_000


class SumIndex:
    """Lengths by the sums of one, two and three of them.

    ``free[n]`` counts the pieces of length n and only falls, so a pair that is used up leaves the
    index for good: ``next`` leads from each pair to the next one that may still be there.
    """

    def __init__(self, free: list[int]):
        self.free = free
        lengths = np.flatnonzero(np.array(free)).astype(np.int32)
        a = np.concatenate([np.zeros(0, dtype=np.int32), *[np.full(np.count_nonzero(lengths <= min(n, len(free) - 1 - n)), n, dtype=np.int32) for n in lengths]])
        sums = a + np.concatenate([np.zeros(0, dtype=np.int32), *[lengths[lengths <= min(n, len(free) - 1 - n)] for n in lengths]])
        order = np.lexsort((-a, sums))  # by sum, the longest first
        self.first = array("i", a[order].tobytes())
        self.begin = np.searchsorted(sums[order], np.arange(len(free) + 1)).tolist()
        self.next = array("i", np.arange(len(a) + 1, dtype=np.int32).tobytes())
        self.lengths = lengths[::-1].tolist()
        self.third = [0] * len(free)

    def _live(self, i: int) -> int:
        while self.next[i] != i:
            self.next[i] = self.next[self.next[i]]
            i = self.next[i]
        return i

    def _pairs(self, gap: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs with this sum that are there, their longer length at most ``most``."""
        end = self.begin[gap + 1]
        i = self._live(bisect_left(self.first, -most, self.begin[gap], end, key=lambda a: -a))
        while i < end:
            a = self.first[i]
            if self.free[a] > (2 * a == gap) and self.free[gap - a] > 0:
                yield a, gap - a
            else:
                self.next[i] = i + 1
            i = self._live(i + 1)

    def singles(self, gap: int, most: int) -> tuple[int, ...] | None:
        return (gap,) if gap <= most and self.free[gap] > 0 else None

    def pairs(self, gap: int, most: int) -> tuple[int, ...] | None:
        return next(self._pairs(gap, most), None)

    def triples(self, gap: int, most: int) -> tuple[int, ...] | None:
        """The longest length and a pair no longer than it; a length that no pair completes isn't tried for this sum again."""
        while (k := self.third[gap]) < len(self.lengths) and 3 * (a := self.lengths[k]) >= gap:
            if a <= most and a < gap - 1 and self.free[a] > 0:
                for b, c in self._pairs(gap - a, a):
                    if self.free[a] > (a == b) + (a == c) and self.free[b] > (a == b) + (b == c):
                        return a, b, c
            self.third[gap] += 1
        return None


def _fill(free: list[int], kinds: list[str], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Use up ``free`` by sequences that the longest piece and an exact complement of its gap fill."""
    out, index = [], SumIndex(free)
    for first in range(capacity - 1, 0, -1):
        while free[first] > 0:
            free[first] -= 1
            found = next((x for kind in kinds if (x := getattr(index, kind)(capacity - first, first))), None)
            free[first] += 1
            if found is None:
                break
            own = Counter((first, *found))
            times = min(free[n] // k for n, k in own.items())
            out.append((times, (first, *found)))
            for n, k in own.items():
                free[n] -= times * k
    return out


def _best_fit(free: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """What is left, longest first, each into the fullest sequence that still has room."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n in range(capacity, 0, -1):
        left = free[n]
        while left:
            room = next((r for r in range(n, capacity) if bins.get(r)), None)
            if room is None:
                each = capacity // n
                for times, k in ((left // each, each), (1, left % each)):
                    if times and k:
                        bins[capacity - n * k].append((times, (n,) * k))
                break
            times, held = bins[room].pop()
            each = min(room // n, left)
            use = min(times, left // each)
            bins[room - n * each].append((use, held + (n,) * each))
            if times > use:
                bins[room].append((times - use, held))
            left -= use * each
    return [x for own in bins.values() for x in own]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """``(times, lengths)``: ``times`` sequences of these lengths each, using up ``counts``.

    Gaps are filled by exact complements while they last: by one, two and three pieces for each
    length in turn, or first by one piece for all lengths, then by two, then by three; then the rest
    goes best-fit.  The order that needs fewer sequences is taken.
    """
    made = []
    for orders in ([["singles", "pairs", "triples"]], [["singles"], ["pairs"], ["triples"]], [["singles"], ["pairs"]], [["singles"]]):
        free = [counts.get(n, 0) for n in range(capacity + 1)]
        out = [(free[capacity], (capacity,))] if free[capacity] else []
        free[capacity] = 0
        for kinds in orders:
            out += _fill(free, kinds, capacity)
        made.append(out + _best_fit(free, capacity))
    return min(made, key=lambda m: sum(times for times, _ in m))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: a document longer than ``capacity`` is cut, its first piece the shorter."""

    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary, remembered)
        for batch in batches:
            for doc_ids, texts in texts_in(batch):
                rows = []
                for doc_id, packed in zip(doc_ids, encoder.packed_many(texts)):
                    packed += end
                    n = len(packed) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(doc_id, k, b, e - b, zlib.crc32(own := packed[4 * b : 4 * e]), own) for k, (b, e) in enumerate(zip(edges, edges[1:]))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.transform(in_arrow, work, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``: every piece and its place.

    ``remembered`` bounds a worker's memory of encoded text pieces and changes no result.
    A null text is empty and so is its end id alone; an empty table gives no rows.  Repeated
    rows are packed each on their own, and so are rows whose id is null.  A text of any length is encoded whole and
    cut into pieces of ``capacity``; which of equally long pieces goes where is free.
    """
    spark = docs.sparkSession
    # a key of its own for each piece, fixed by writing it: ids may repeat or be null
    rows = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, remembered).withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``capacity`` rows at most
    slots, sequence, used = [], 0, defaultdict(int)
    for times, lengths in plan(counts, capacity):
        offset = 0
        for n in lengths:
            slots.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    # no more slots than a small multiple of ``capacity``, whatever the number of pieces
    places = spark.createDataFrame(slots, "length long, first long, last long, sequence long, offset long")
    share = F.pmod(F.xxhash64("piece_key"), F.lit(sum(counts.values()) // RANK_GROUP + 1))
    dealt = rows.select("piece_key", "length", share.alias("share"))
    group = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = group.select("length", "share", (F.sum("n").over(W.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "share").orderBy("piece_key")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, ["length", "share"]).select("piece_key", "length", (F.col("rank") + F.col("before")).alias("rank"))
    at = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["first"]) & (ranked["rank"] < places["last"]))
    at = at.select("piece_key", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    return rows.join(at, "piece_key").drop("piece_key")
