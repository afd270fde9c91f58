"""Vector code compression: product-quantised integer vectors with exact nearest entries.

Vectors are cut into equal consecutive parts, each with a codebook of its own.  A round broadcasts
one kd-tree a codebook (its size is set by the parameters, never by the rows), every task finds
the nearest entry of each part by branch and bound and sends back one integer sum and count for
each entry it met, and the sums give the next entries.  A subtree is left out only where its bound
passes the best distance, so of equally near entries the one of the lower index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, join_totals, named, stored

LEAF = 8
#: Integer components beyond this count as this, so that squared distances stay in 64 bits.
LARGEST = 1 << 27


@dataclass
class Node:
    """A leaf holds ``entries`` in ascending order of index, an inner node a cut at ``at`` of dimension ``dim``."""

    entries: np.ndarray | None = None
    dim: int = 0
    at: int = 0
    low: Node | None = None
    high: Node | None = None


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """Entries of ``book`` up to the cut go low, those above it high; equal entries share a leaf whatever their number."""
    entries = np.arange(len(book)) if entries is None else entries
    points = book[entries]
    spread = points.max(axis=0) - points.min(axis=0)
    dim = int(spread.argmax())
    if len(entries) <= LEAF or not spread[dim]:
        return Node(entries=np.sort(entries))
    at = int(np.sort(points[:, dim])[(len(entries) - 1) // 2])
    if at == points[:, dim].max():
        at = int(points[points[:, dim] < at, dim].max())
    low = points[:, dim] <= at
    return Node(dim=dim, at=at, low=kd_tree(book, entries[low]), high=kd_tree(book, entries[~low]))


def nearest(tree: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, ties to the lower index.

    All points walk the tree together: those on one side of a cut visit that side first, then those
    whose bound to the other side doesn't pass their best distance follow there.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(book), dtype=np.int64)

    def visit(node: Node, own: np.ndarray, offsets: np.ndarray) -> None:
        # offsets: how far each point lies outside of the node's box in each dimension
        if node.entries is not None:
            away = points[own][:, None, :] - book[node.entries][None, :, :]
            d = np.einsum("npd,npd->np", away, away)
            at = d.argmin(axis=1)
            d, entry = d[np.arange(len(own)), at], node.entries[at]
            better = (d < best[own]) | ((d == best[own]) & (entry < index[own]))
            best[own[better]], index[own[better]] = d[better], entry[better]
            return
        x = points[own, node.dim]
        for near, far, side in ((node.low, node.high, x <= node.at), (node.high, node.low, x > node.at)):
            if not side.any():
                continue
            here, out = own[side], offsets[side]
            visit(near, here, out)
            out = out.copy()
            # the high side starts at the cut plus one, as all components are integers
            out[:, node.dim] = np.maximum(out[:, node.dim], node.at + 1 - points[here, node.dim] if far is node.high else points[here, node.dim] - node.at)
            open_ = np.einsum("nd,nd->n", out, out) <= best[here]
            if open_.any():
                visit(far, here[open_], out[open_])

    if len(points) and len(book):
        visit(tree, np.arange(len(points)), np.zeros_like(points))
    return index, best


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Rows, parts, components."""
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def integer_vectors(vectors: DataFrame, scale: int, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` of the sound vectors, components ``floor(scale * x)``."""
    x = F.col("x")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = vectors.select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("x"))
    own = own.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0)).where(F.coalesce(sound, F.lit(False)))
    bounded = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return own.select("vec_id", "label", bounded.alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors of the ``entries`` least ids, ascending; a report of a fixed number of rows."""
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).select("v").collect()
    held = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1)
    return [held[:, p] for p in range(parts)]


def _next_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries replaced by the floored means of the parts that are nearest to them."""
    sent = rows.sparkSession.sparkContext.broadcast([(kd_tree(b), b) for b in books])
    parts, width = len(books), books[0].shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch, parts)
            for p, (tree, book) in enumerate(sent.value):
                index, _ = nearest(tree, book, v[:, p])
                np.add.at(sums[p], index, v[:, p])
                counts[p] += np.bincount(index, minlength=len(book))
        met = [(p, int(e)) for p in range(parts) for e in np.flatnonzero(counts[p])]
        cols = [pa.array([p for p, _ in met], pa.int32()), pa.array([e for _, e in met], pa.int32()), pa.array([int(counts[p][e]) for p, e in met], pa.int64()), pa.array([sums[p][e].tolist() for p, e in met], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "total"])

    partial = rows.select("v").transform(in_arrow, work, "part int, entry int, n long, total array<long>")
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(width)])
    out = [b.copy() for b in books]
    for r in summed.collect():  # one row an entry
        out[r["part"]][r["entry"]] = [r[f"d{d}"] // r["n"] for d in range(width)]
    sent.unpersist()
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, codes, error, label_error`` of every sound vector, and the codebooks.

    Components become ``floor(scale * x)``.  Codebooks start as the parts of the ``entries`` least ids and
    are moved ``rounds`` times; ``codes`` is one entry index a part, ``error`` the squared distance to
    the coded vector, ``label_error`` its sum over equal labels, nulls together.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose
    length differs from that of the least id or isn't a multiple of ``parts``.  Components beyond
    ``LARGEST`` count as that.  Rows that share an id are each coded, the least vector first; rows
    without an id are coded but start no entry (all, if no row has one: then nothing is coded).  With fewer
    than ``entries`` vectors codebooks are shorter; an empty table gives no rows.
    """
    rows = stored(integer_vectors(vectors, scale, parts, id_col, vector_col, label_col), "vectors")
    least = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if least is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).where("false"), []
    rows = rows.where(F.size("v") == least["n"])
    books = first_books(rows, parts, entries)
    for _ in range(rounds):
        books = _next_books(rows, books)
    sent = rows.sparkSession.sparkContext.broadcast([(kd_tree(b), b) for b in books])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, parts)
            found = [nearest(tree, book, v[:, p]) for p, (tree, book) in enumerate(sent.value)]
            codes, error = np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(error)], ["vec_id", "label", "codes", "error"])

    kind = dict(rows.dtypes)["label"]
    coded = stored(rows.select("vec_id", "label", "v").transform(in_arrow, work, f"vec_id long, label {kind}, codes array<int>, error long"), "codes")
    totals = coded.groupBy("label").agg(F.count("*").alias("held"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    return join_totals(coded, totals, "label", "held").select("vec_id", "label", "codes", "error", "label_error"), books
