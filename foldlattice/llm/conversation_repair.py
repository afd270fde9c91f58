"""Conversation structure repair: cheapest edits that give a well-formed order of roles.

Rows are dealt out by conversation, and every task hands batches of whole conversations to one
in-process DuckDB query.  It orders and judges the rows, then recurses: each step advances one turn
for all conversations of the batch and keeps, for each state of the role grammar, the least cost and
its audit.  The audit is then read back along the rows to give the repaired conversation.

Well-formed is ``(s?(ua)+)?`` over role initials: nothing, or an optional system turn followed by
user and assistant turns in pairs.  Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an
empty user or assistant turn 5.  Blank and duplicate rows must go; a truncated row that stays costs 5 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, named

#: Rows and bytes from which a batch of conversations is handed over; one conversation is never parted.
BATCH_ROWS, BATCH_BYTES = 20_000, 16_000_000
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: State to the states that the next role's initial leads to; the states 0 (nothing yet) and 3 may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "g long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """States within reach of ``state`` by inserted turns alone, with cost and letters; two always suffice."""
    out, at = [(state, 0, "")], state
    for n in (1, 2):
        at = next(q for initial, q in GRAMMAR[at].items() if initial in "ua")
        if at not in [q for q, *_ in out]:
            out.append((at, n * INSERT, "I" * n))
    return out


def moves() -> list[tuple[int, str | None, bool, int, int, str]]:
    """``(state, initial or None for any, stays, next state, cost, letters)`` of one row and the insertions behind it."""
    out = []
    for state, steps in GRAMMAR.items():
        own = [(None, False, state, DELETE, "D")]
        own += [(initial, True, q, KEEP, "K") for initial, q in steps.items()]
        own += [(None, True, q, REROLE, "R") for initial, q in steps.items() if initial in "ua"]
        out += [(state, initial, stays, r, cost + more, letter + letters) for initial, stays, q, cost, letter in own for r, more, letters in _inserted(q)]
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


#: Rows of ``turns`` (g, turn, role, text, present) in order, each with its first fault.
JUDGED = """
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM turns WHERE present)
SELECT g, i, turn, role, text, left(role, 1) AS initial,
  CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
FROM placed
"""
#: Least cost and audit of each grammar state after every row; one turn of all conversations a recursion.
ADVANCE = f"""
WITH RECURSIVE moves(state, initial, stays, next, cost, letters) AS (VALUES {_values(moves())}),
starts(state, cost, letters) AS (VALUES {_values(_inserted(0))}),
best(g, state, i, cost, audit) USING KEY (g, state) AS (
  SELECT g, s.state, CAST(0 AS BIGINT), CAST(s.cost AS BIGINT), CAST(s.letters AS VARCHAR) FROM (SELECT DISTINCT g FROM judged), starts s
  UNION
  SELECT g, next, i, least_one.cost, least_one.audit FROM (
    SELECT b.g, m.next, j.i, min({{'cost': b.cost + m.cost + CASE WHEN m.stays AND j.fault = 'truncated' THEN {CUT_SHORT} ELSE 0 END, 'audit': b.audit || m.letters}}) AS least_one
    FROM best b JOIN judged j ON j.g = b.g AND j.i = b.i + 1
      JOIN moves m ON m.state = b.state AND (m.initial IS NULL OR m.initial = j.initial) AND (NOT m.stays OR j.fault NOT IN ('blank', 'duplicate'))
    GROUP BY b.g, m.next, j.i)
)
SELECT g, arg_min(audit, {{'cost': cost, 'audit': audit}}) AS audit, min(cost) AS cost FROM best WHERE state IN (0, 3) GROUP BY g
"""
#: The audit's letters beside their rows: kept turns as they are, others by their place behind the system turn.
REPAIRED = """
WITH letters AS (SELECT g, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS k FROM audits WHERE audit <> ''),
placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER upto AS i, count(*) FILTER (letter <> 'D') OVER upto AS place
  FROM letters WINDOW upto AS (PARTITION BY g ORDER BY k ROWS UNBOUNDED PRECEDING)),
beside AS (
  SELECT p.g, p.k, p.letter, p.place, j.role, CASE WHEN p.letter = 'I' THEN '' ELSE j.text END AS text,
    max(CASE WHEN p.place = 1 AND p.letter = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.g) AS led
  FROM placed p LEFT JOIN judged j ON j.g = p.g AND j.i = p.i AND p.letter <> 'I' WHERE p.letter <> 'D')
SELECT g, list({'role': CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, 'text': text} ORDER BY k) AS repaired FROM beside GROUP BY g
"""
#: One row a conversation, also those without rows.
REPORT = """
WITH counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY i) AS before FROM judged) GROUP BY g)
SELECT a.g, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, []) AS repaired
FROM (SELECT DISTINCT g FROM turns) a LEFT JOIN counts USING (g) LEFT JOIN audits USING (g) LEFT JOIN repaired USING (g) ORDER BY g
"""


def repair_batch(turns: pa.Table) -> pa.Table:
    """The report of every conversation ``g`` in ``turns`` (g, turn, role, text, present)."""
    with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"}) as db:
        db.register("turns", turns)
        for name, sql in (("judged", JUDGED), ("audits", ADVANCE), ("repaired", REPAIRED)):
            db.execute(f"CREATE TEMP TABLE {name} AS {sql}")
        return db.sql(REPORT).to_arrow_table()


def _reported(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """``repair_batch`` of rows that name their conversation by ``conv_id``."""
    place: dict[str | None, int] = {}
    g = np.array([place.setdefault(n, len(place)) for n in rows["conv_id"].to_pylist()], dtype=np.int64)
    done = repair_batch(rows.select(["turn", "role", "text", "present"]).append_column("g", pa.array(g)))
    ids = pa.array(list(place), pa.string()).take(done["g"].combine_chunks())
    yield from done.drop(["g"]).add_column(0, "conv_id", ids).to_batches()


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` of every row of a conversation table, hurt by its crc32.

    The remainder by 20 of crc32 of ``conv_id:turn`` decides: 0 drops the row (``present`` is false), 1
    empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes its role user.  A null counts as one space.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("hurt"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("hurt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hurt") != 0).alias("present"),
        F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` of every conversation.

    ``repaired`` is the mended list of (role, text); ``audit`` holds the initials of the cheapest edits in
    order, the ASCII-least of equally cheap ones.  Rows are taken by turn, nulls first, rows of one
    turn by role and text.  Where ``present`` is false a row only names its conversation; one without
    present rows gets zeros, an empty audit and an empty list.  Null role or text counts as empty (so
    blank); a null conversation id is one conversation.  Repeated rows are duplicates; an empty table gives no rows.

    A conversation's audit is one value that is found from its first turn to its last, so a
    conversation is the one group that meets whole in a task; nothing larger does.
    """
    own = conversations.select(
        named(conv_col).alias("conv_id"),
        named(turn_col).cast("long").alias("turn"),
        F.coalesce(named(role_col), F.lit("")).alias("role"),
        F.coalesce(named(text_col), F.lit("")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    kind = dict(own.dtypes)["conv_id"]
    keyed = own.select(F.xxhash64("conv_id", F.col("conv_id").isNull()).alias("h"), F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "text", "present")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < BATCH_ROWS and sum(x.nbytes for x in held) < BATCH_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # rows before the last key, which may go on
            if whole:
                yield from _reported(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from _reported(pa.Table.from_batches(held))

    dealt = keyed.repartition("h").sortWithinPartitions("h")
    out = dealt.transform(in_arrow, work, SCHEMA.replace("g long", "conv_id string", 1))
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
