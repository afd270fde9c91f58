"""MinHash near-duplicate components by an inverted join over signature coordinates.

1. Each text becomes a set of word shingles, a key of the whole set and ``coordinates`` minima.
   Texts with equal sets form one class; only its smallest id goes on.
2. Every (coordinate, value) pair is a posting list.  Values that one class alone holds can't
   collide, so only repeated ones are posted, each class's rarest first.  Two classes that agree
   in ``match`` coordinates must share a value among all but the last ``match - 1`` of either's
   repeated values: only that prefix is posted, and a class with fewer than ``match`` repeated
   values is skipped altogether.
3. In a list, agreeing coordinates are counted between members not yet joined; the list yields a
   spanning forest of its pairs with at least ``match`` collisions, never all pairs.  Long lists are
   cut in blocks, and blocks are compared two at a time.
4. The forests' components are families.  A family's full sets meet in blocks, pairs at or above
   ``match`` collisions are confirmed exactly, and confirmed links give the components.

``match`` is the largest count that a pair exactly at the similarity limit misses with a
probability of at most ``miss``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import by_groups, components, in_arrow, stored
from foldlattice.llm.textblocks import mix, shingle_sets, slices

COORDINATES = 64
MISS = 1e-6
#: Members of a posting list, and classes of a family, that meet in one block.
LIST_BLOCK = 1024
FAMILY_BLOCK = 512


def match_threshold(coordinates: int, percent: int, miss: float) -> int:
    """Largest t with P(Binomial(coordinates, percent / 100) < t) <= miss, at least 1."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature, marks`` of every row; without a word: 0 and nulls.

    ``marks`` holds 32 bits of each coordinate, for counting.
    """
    factors = multipliers(coordinates)[:, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices([len(t or "") for t in texts]):
                counts, keys, minima, marks = [], [], [], []
                for s in shingle_sets(texts[part], size):
                    counts.append(len(s))
                    least = reduce(np.minimum, ((piece[None, :] * factors).min(axis=1) for piece in np.array_split(s, len(s) // 4096 + 1))) if len(s) else None
                    keys.append(None if least is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    minima.append(None if least is None else least.view(np.int64))
                    marks.append(None if least is None else mix(least).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature", "marks"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(in_arrow, work, "doc_id long, n_shingles long, set_key binary, signature array<long>, marks binary")


def postings(classes: DataFrame, match: int) -> DataFrame:
    """``value, doc_id`` for the rare-first prefix of each class that could still match another."""
    posts = classes.select("doc_id", F.posexplode("signature").alias("coordinate", "minimum")).select("doc_id", F.xxhash64("coordinate", "minimum").alias("value"))
    repeated = posts.groupBy("value").agg(F.count("*").alias("held_by")).where("held_by > 1")
    return (
        posts.join(repeated, "value")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("held_by", "value"))).alias("own"))  # one entry a coordinate at most
        .where(F.size("own") >= match)
        .select("doc_id", F.explode(F.slice("own", F.lit(1), F.size("own") - (match - 1))).alias("p"))
        .select(F.col("p.value").alias("value"), "doc_id")
    )


def _blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row of a group once for each pair of blocks that it is part of: adds ``lo`` and ``hi``."""
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks.cast("int") - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    return rows.select("*", F.explode(pair).alias("met")).select(key, "doc_id", F.col("met.lo").alias("lo"), F.col("met.hi").alias("hi"))


def _marks(rows: pa.Table, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows["marks"].to_pylist()), dtype=np.uint32).reshape(len(rows), coordinates)


def _forest(marks: np.ndarray, match: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with at least ``match`` equal coordinates."""
    if len(marks) == 2:
        return [(0, 1)] if np.count_nonzero(marks[0] == marks[1]) >= match else []
    out, left = [], np.arange(len(marks))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (marks[left] == marks[x]).sum(axis=1) >= match
            out += [(x, y) for y in left[near]]
            queue.extend(left[near])
            left = left[~near]
    return out


def candidate_forest(classes: DataFrame, match: int, coordinates: int = COORDINATES) -> DataFrame:
    """``a, b``: spanning forests of the candidate pairs of all posting lists."""
    posts = stored(postings(classes, match), "postings")
    lists = posts.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    met = _blocks(posts.join(lists, "value"), "value", F.ceil(F.col("n") / F.lit(LIST_BLOCK)))
    met = met.join(classes.select("doc_id", "marks"), "doc_id")

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, marks = rows["doc_id"].to_numpy(), _marks(rows, coordinates)
        found = [(ids[b + x], ids[b + y]) for b, e in zip(bounds, bounds[1:]) for x, y in _forest(marks[b:e], match)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return by_groups(met, ["value", "lo", "hi"], work, "a long, b long").distinct()


def _links(ids: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], match: int, percent: int) -> Iterator[tuple[int, int]]:
    """Confirmed links that join what is not yet joined; every candidate across components is confirmed on full sets."""
    root = np.arange(len(ids))
    sizes = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum([0, *sizes])
    flag = np.zeros(inverse.max() + 1, dtype=bool)
    for x in range(len(ids) - 1):
        later = np.arange(x + 1, len(ids))
        later = later[root[later] != root[x]]
        later = later[(marks[later] == marks[x]).sum(axis=1) >= match]
        if not len(later):
            continue
        own = inverse[starts[x] : starts[x + 1]]
        flag[own] = True
        common = np.array([np.count_nonzero(flag[inverse[starts[y] : starts[y + 1]]]) for y in later])
        flag[own] = False
        for y in later[100 * common >= percent * (sizes[later] + sizes[x] - common)]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                yield ids[x], ids[y]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 85, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id``: one row for each row of ``docs``.

    Linked are texts with ``100 * |A and B| >= percent * |A or B|`` over distinct word shingles;
    ``component_id`` is the smallest id reachable by links, ``class_id`` the smallest id with an
    equal set.  A text without words (or null) has no shingles and stays alone; a text of fewer
    than ``size`` words is one shingle.  Rows without an id are left out; rows that share an id and a
    text are judged alike.  An empty table gives no rows.  Sets are of whole texts, however long, and hold 64-bit
    hashes of shingles, by which links are confirmed; a task holds the sets of one block of a family.
    """
    match = match_threshold(coordinates, percent, miss)
    docs = docs.where(F.col(id_col).isNotNull())
    marked = stored(signatures(docs, id_col, text_col, size, coordinates), "signatures")
    classes = stored(marked.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles")), "classes")
    alone = marked.join(classes.select("doc_id"), "doc_id", "left_semi")
    joined = stored(components(candidate_forest(alone, match, coordinates)), "families")
    found = components(confirmed_links(docs, alone, joined, id_col, text_col, size, percent, coordinates, match))
    labels = classes.join(found, classes["doc_id"] == found["node"], "left").select("set_key", F.col("doc_id").alias("class_id"), F.coalesce("root", "doc_id").alias("root"))
    out = marked.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def confirmed_links(docs: DataFrame, classes: DataFrame, joined: DataFrame, id_col: str, text_col: str, size: int, percent: int, coordinates: int, match: int) -> DataFrame:
    """``a, b``: links confirmed on full sets, enough to connect each component."""
    sizes = joined.groupBy("root").agg(F.count("*").alias("n"))
    met = _blocks(joined.join(sizes, "root").select("root", F.col("node").alias("doc_id"), "n"), "root", F.ceil(F.col("n") / F.lit(FAMILY_BLOCK)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(joined.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for part in slices([len(t or "") for t in own]):
                packed = [s.tobytes() for s in shingle_sets(own[part], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(packed, pa.binary())], ["doc_id", "members"])

    sets = texts.transform(in_arrow, sets_of, "doc_id long, members binary").join(classes.select("doc_id", "marks"), "doc_id")
    met = met.join(sets, "doc_id")

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for b, e in zip(bounds, bounds[1:]):
            if e - b > 1:
                part = rows.slice(b, e - b)
                found += _links(part["doc_id"].to_numpy(), _marks(part, coordinates), [np.frombuffer(s, dtype=np.uint64) for s in part["members"].to_pylist()], match, percent)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return by_groups(met, ["root", "lo", "hi"], work, "a long, b long").distinct()
