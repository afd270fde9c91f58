"""Language-model scores by a weighted backoff automaton over bigrams of the whole corpus.

Counts stay sharded.  Documents are scored in batches; a batch's distinct n-grams, with the counts
of its own training rows, go to shards by key, are summed there, and each batch gets back the
totals that differ from its own counts.  With them it builds the automaton of its own n-grams:
a state for each history, an arc for each known continuation, a failure arc to the root that costs
the history's backoff weight.  One traversal of the batch's texts, from left to right and all in
step, carries a state for each text, follows failure arcs and adds up log-probabilities.

The smoothed probability of w after v is ``(c(vw) + mu * p(w)) / (c(v) + mu)`` with the add-0.1
unigram probability ``p``; its failure weight is therefore ``mu / (c(v) + mu)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import by_groups, in_arrow
from foldlattice.llm.textblocks import U64, Words, mix, slices

END, START = U64(1), U64(2)
MU = 300.0
#: Characters of text after which a scoring batch ends, and for which a shard of counts is planned.
BATCH_CHARS = 16_000_000
SHARD_CHARS = 8_000_000
#: Bytes of rows that are packed together.
PACKED_BYTES = 16_000_000


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words, then one end a text) and each text's first place."""
    runs = list(slices([len(t or "") for t in texts]))
    if len(runs) > 1:
        tokens, starts, at = [], [np.zeros(1, dtype=np.int64)], 0
        for run in runs:
            own, places = tokens_of(texts[run])
            tokens.append(own)
            starts.append(places[1:] + at)
            at += int(places[-1])
        return np.concatenate(tokens), np.concatenate(starts)
    words = Words(texts)
    n = np.diff(words.bounds)
    starts = words.bounds + np.arange(len(texts) + 1)
    out = np.full(int(starts[-1]), END, dtype=np.uint64)
    out[np.arange(len(words.hashes)) + np.repeat(np.arange(len(texts)), n)] = words.hashes
    return out, starts


def histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each token, or the start mark."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[starts[:-1]] = START
    return out


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    """56 bits a token: sorted, their differences need fewer bytes than full ones."""
    return mix(tokens * U64(0xC2B2AE3D27D4EB4F) + U64(5)) >> U64(8)


def bigram_keys(history: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(history * U64(0x9E3779B185EBCA87) + tokens * U64(0x165667B19E3779F9)) >> U64(8)


@dataclass
class BackoffAutomaton:
    """A weighted automaton: state 0 is the root, which has an arc for every symbol.

    ``arcs`` are sorted ``state * symbols + symbol`` with a cost and a target; a state without an arc
    for a symbol pays ``failure`` and hands the symbol on to the shorter history ``shorter``.
    """

    symbols: int
    arcs: np.ndarray
    cost: np.ndarray
    target: np.ndarray
    failure: np.ndarray
    shorter: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost of reading a symbol in each state, by failure arcs where need be, and the states reached."""
        paid, state, waiting = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(waiting):
            code = state[waiting] * self.symbols + symbol[waiting]
            at = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
            found = self.arcs[at] == code
            read, at = waiting[found], at[found]
            paid[read] += self.cost[at]
            state[read] = self.target[at]
            waiting = waiting[~found]
            paid[waiting] += self.failure[state[waiting]]
            state[waiting] = self.shorter[state[waiting]]
        return paid, state

    def walk(self, symbols: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
        """Summed costs of all texts, each read once from left to right from state ``begin``, all texts in step."""
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")  # so that the texts still being read are the first ones
        first, ends = starts[:-1][order], -length[order]
        state, total = np.full(len(order), begin, dtype=np.int64), np.zeros(len(order))
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(ends, -k))  # texts longer than k
            paid, state[:live] = self.step(state[:live], symbols[first[:live] + k])
            total[:live] += paid
        out = np.empty(len(order))
        out[order] = total
        return out


def backoff_automaton(root_p: np.ndarray, held: np.ndarray, history: np.ndarray, symbol: np.ndarray, counts: np.ndarray, mu: float) -> BackoffAutomaton:
    """The automaton of symbols 0 to n-1 with probabilities ``root_p`` and of known bigrams with their ``counts``.

    States: 0 the root, 1 the start of a text, k + 2 symbol k as history; ``held[state]`` is how often a
    history was seen.  A bigram that was not seen has no arc.
    """
    n = len(root_p)
    every = np.arange(n)
    known = counts > 0
    history, symbol, counts = history[known], symbol[known], counts[known]
    arcs = np.concatenate((every, history * n + symbol))
    cost = np.log10(np.concatenate((root_p, (counts + mu * root_p[symbol]) / (held[history] + mu))))
    order = np.argsort(arcs, kind="stable")
    return BackoffAutomaton(n, arcs[order], cost[order], np.concatenate((every, symbol))[order] + 2, np.log10(mu / (held + mu)), np.zeros(n + 2, dtype=np.int64))


def counted(parts: list[np.ndarray], flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (under 2^63) of all parts in order, and how many of each are flagged; uses up the parts."""
    both = np.concatenate(parts)
    parts.clear()
    both <<= U64(1)
    both |= np.resize(flags, len(both))
    both.sort()
    if not len(both):
        return both, np.zeros(0, dtype=np.int64)
    flagged = (both & U64(1)).astype(np.int64)
    both >>= U64(1)
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[at], np.add.reduceat(flagged, at)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widened(packed: bytes, n: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    if packed[at]:
        wide[:, : packed[at]] = np.frombuffer(packed, dtype=np.uint8, offset=at + 1).reshape(n, packed[at])
    return wide.view("<u8").ravel()


def pack_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as their number, the first one and narrow differences; and their narrow counts."""
    if not len(keys):
        return b"", b""
    return np.array([len(keys), keys[0]], dtype="<u8").tobytes() + _narrow(np.diff(keys)), _narrow(counts)


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, dtype=np.uint64)
    n, first = np.frombuffer(packed, dtype="<u8", count=2).tolist()
    return np.cumsum(np.concatenate((np.array([first], dtype=np.uint64), _widened(packed, n - 1, 16))), dtype=np.uint64)


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    return _widened(packed, n).astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _batch_numbers(texts: list[str | None], seen: int) -> tuple[list[int], int]:
    """The batch of each text of a task that has seen so many characters before; batches follow one another in the input's order."""
    out = []
    for text in texts:
        out.append((TaskContext.get().partitionId() << 24) + seen // BATCH_CHARS)
        seen += len(text or "") + 8
    return out, seen


def _count_rows(own: DataFrame, shards: int, orders: tuple[int, ...]) -> DataFrame:
    """``shard, batch, keys, counts``: distinct n-grams of a batch, by ranges of their keys, and their counts in its training rows."""

    def flush(batch: int, texts: list[str | None], training: list[bool]) -> Iterator[pa.RecordBatch]:
        tokens, starts = tokens_of(texts)
        own = np.repeat(np.array(training, dtype=bool), np.diff(starts))
        keys = [unigram_keys(tokens)] if 1 in orders else []
        if 2 in orders:
            keys.append(bigram_keys(histories(tokens, starts), tokens))
        del tokens
        distinct, counts = counted(keys, own)
        shard = (distinct >> U64(24)) * U64(shards) >> U64(32)
        edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(edges))
        packed = [pack_keys(distinct[edges[u] : edges[u + 1]], counts[edges[u] : edges[u + 1]]) for u in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), batch)), *[pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1)]], ["shard", "batch", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, marks, seen = 0, [], [], 0
        for rows in batches:
            training, own_texts = (rows.column(k).to_pylist() for k in (0, 1))
            numbers, seen = _batch_numbers(own_texts, seen)
            for batch, mark, text in zip(numbers, training, own_texts):
                if batch != now and texts:
                    yield from flush(now, texts, marks)
                    texts, marks = [], []
                now = batch
                texts.append(text)
                marks.append(mark)
        if texts:
            yield from flush(now, texts, marks)

    return own.select("training", "text").transform(in_arrow, work, "shard long, batch long, keys binary, counts binary")


def _unpacked(rows: pa.Table, counts: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and counts of each row."""
    keys = [unpack_keys(k) for k in rows["keys"].to_pylist()]
    return keys, [unpack_counts(c, len(k)) for c, k in zip(rows[counts].to_pylist(), keys)]


def _totals(part: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """A shard's key lists, own counts, distinct keys' totals and each key's place among them."""
    keys, counts = _unpacked(part, "counts")
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, counts, np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64), inverse


def _answers(counts: DataFrame, shards: int) -> DataFrame:
    """``batch, keys, totals``: corpus totals that differ from the batch's own counts."""

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b, e in zip(bounds, bounds[1:]):
            part = rows.slice(b, e - b)
            keys, own, totals, inverse = _totals(part)
            total, at, packed = totals[inverse], 0, []
            for mine, counted_here in zip(keys, own):
                all_of = total[at : at + len(mine)]
                at += len(mine)
                other = counted_here != all_of
                packed.append(pack_keys(mine[other], all_of[other]))
            yield pa.RecordBatch.from_arrays([part["batch"].combine_chunks(), *[pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1)]], ["batch", "keys", "totals"])

    return by_groups(counts, ["shard"], work, "batch long, keys binary, totals binary", shards)


def corpus_totals(counts: DataFrame, shards: int) -> tuple[int, int]:
    """Training tokens and distinct training tokens, summed by shard."""

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, v = 0, 0
        for b, e in zip(bounds, bounds[1:]):
            totals = _totals(rows.slice(b, e - b))[2]
            n, v = n + int(totals.sum()), v + int((totals > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([v])], ["n", "v"])

    row = by_groups(counts, ["shard"], work, "n long, v long", shards).agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training`` tells the rows that are learned from.  Batches follow the input's partitions and order, so all
    reads of one input must be planned alike, as those of a file scan are.  A null or empty text is its end alone; an
    empty table gives no rows; repeated rows count each time.  Scores are log10 probabilities of whole texts; a very
    long text is a batch of its own.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), training.cast("boolean").alias("training"))
    # a row an input partition
    sizes = [r["chars"] for r in own.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("chars")).collect()]
    shards = max(1, -(-sum(sizes) // SHARD_CHARS))
    n_train, n_distinct = corpus_totals(_count_rows(own, shards, (1,)), shards)
    kind = own.schema["doc_id"].dataType.simpleString()
    answers = _answers(_count_rows(own, shards, (1, 2)), shards).select("batch", F.lit(None).cast("binary").alias("rows"), "keys", "totals")
    asked = _packed_rows(own).select("batch", "rows", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("totals"))

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b, e in zip(bounds, bounds[1:]):
            part = rows.slice(b, e - b)
            told = part.filter(part["keys"].is_valid())
            mine = [pa.ipc.open_stream(x).read_all() for x in part["rows"].drop_null().to_pylist()]
            if not mine:
                continue
            mine = pa.concat_tables(mine)
            marks = np.array(mine["training"].to_pylist(), dtype=bool)
            scores = _score_batch(mine["text"].to_pylist(), marks, *_unpacked(told, "totals"), n_train, n_distinct, mu)
            yield pa.RecordBatch.from_arrays([mine["doc_id"].combine_chunks(), pa.array(marks), *[pa.array(x) for x in scores]], ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return by_groups(asked.unionByName(answers), ["batch"], work, f"doc_id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", max(1, sum(n // BATCH_CHARS + 1 for n in sizes)))


def _packed_rows(own: DataFrame) -> DataFrame:
    """``batch, rows``: documents as compressed Arrow streams, which travel in less than plain rows."""

    def packed(batch: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        whole = pa.Table.from_batches(held).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "rows"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, seen = 0, [], 0, 0
        for rows in batches:
            numbers, seen = _batch_numbers(rows.column(1).to_pylist(), seen)
            edges = [0, *[k for k in range(1, len(numbers)) if numbers[k] != numbers[k - 1]], len(numbers)]
            for b, e in zip(edges, edges[1:]):
                if b == e:
                    continue
                if held and (numbers[b] != now or size > PACKED_BYTES):
                    yield packed(now, held)
                    held, size = [], 0
                now = numbers[b]
                held.append(rows.slice(b, e - b))
                size += held[-1].nbytes
        if held:
            yield packed(now, held)

    return own.select("doc_id", "text", "training").transform(in_arrow, work, "batch long, rows binary")


def _score_batch(texts: list[str | None], training: np.ndarray, keys: list[np.ndarray], totals: list[np.ndarray], n_train: int, n_distinct: int, mu: float) -> list[np.ndarray]:
    tokens, starts = tokens_of(texts)
    own = np.repeat(training, np.diff(starts))
    told = np.concatenate([np.zeros(0, dtype=np.uint64), *keys])
    totals = np.concatenate([np.zeros(0, dtype=np.int64), *totals])
    keys.clear()
    order = np.argsort(told)
    told, totals = told[order], totals[order]

    def corrected(wanted: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(told):
            return counts
        at = np.minimum(np.searchsorted(told, wanted), len(told) - 1)
        return np.where(told[at] == wanted, totals[at], counts)

    distinct, symbol = np.unique(tokens, return_inverse=True)
    del tokens
    size = len(distinct)
    unigrams = corrected(unigram_keys(distinct), np.bincount(symbol[own], minlength=size).astype(np.int64))
    root = (unigrams + 0.1) / (n_train + 0.1 * (n_distinct + 1))
    # each text has one start and one end, so the start is a history as often as the end is a token
    held = np.concatenate(([0], unigrams[distinct == END], unigrams))
    before = np.empty(len(symbol), dtype=np.int64)
    before[1:] = symbol[:-1] + 2
    before[starts[:-1]] = 1
    codes, place = np.unique(before * size + symbol, return_inverse=True)
    name = np.concatenate((np.array([0, START], dtype=np.uint64), distinct))
    bigrams = corrected(bigram_keys(name[codes // size], distinct[codes % size]), np.bincount(place[own], minlength=len(codes)).astype(np.int64))
    del before, place, told, totals
    score = backoff_automaton(root, held, codes // size, codes % size, bigrams, mu).walk(symbol, starts, 1)
    base = np.add.reduceat(np.log10(root)[symbol], starts[:-1])
    seen = np.add.reduceat((unigrams > 0)[symbol].astype(np.int64), starts[:-1])
    return [np.diff(starts).astype(np.int64), seen, np.full(len(texts), n_train, dtype=np.int64), base, score]
