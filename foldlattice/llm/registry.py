"""Queries of the training-data operators: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlattice.llm.common import table, training_hash
from foldlattice.llm.conversation_repair import damage, repair_conversations
from foldlattice.llm.dedup import near_duplicates
from foldlattice.llm.encoding import round_trip
from foldlattice.llm.language_id import fit, predict
from foldlattice.llm.license_scan import scan_licenses
from foldlattice.llm.lm_scoring import score_documents
from foldlattice.llm.packing import pack
from foldlattice.llm.quality_classifier import quality_classifier
from foldlattice.llm.quality_rules import quality_rules
from foldlattice.llm.topk_search import top_k
from foldlattice.llm.vector_codes import books_digest, compress_vectors
from foldlattice.llm.warc import archive, page_records, reconstruct
from foldlattice.llm.wavelet import new_shard_folder, read_documents, write_shards

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_shard_folder(docs)
    write_shards(docs, VOCABULARY, path, end_id=0)
    return read_documents(spark.read.parquet(path), with_ids=False)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), F.pmod(training_hash(F.col("doc_id")), F.lit(10)) != 0)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "perplexity", "perplexity_limit", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.pmod(training_hash(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"))
    out = predict(docs.select("doc_id", "held_out", "text"), fit(docs.where("not held_out")), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op10_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = reconstruct(*archive(page_records(table(spark, sf_dir, "pages"))))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damage(table(spark, sf_dir, "conversations")), present=F.col("present"))
    whole = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(whole.cast("binary"), 256).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_wavelet_shards, op3_best_fit_packing, op4_backoff_lm, op5_license_scan, op6_kneser_ney_quality, op7_quality_rules, op8_threshold_topk, op9_language_id, op10_forced_boundary_bpe, op11_vector_codes, op12_warc_archive, op13_conversation_repair)}


TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


#: Three rounds of nearest entries, books b0 to b2; a part's four components are a to d.
CODES_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (SELECT r, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS e, a, b, c, d FROM parts WHERE r <= 64),
{rounds}
coded AS (SELECT k.vec_id, k.label, string_agg(format('{{:02x}}', n.at.e), '' ORDER BY n.p) AS code, CAST(sum(n.at.away) AS BIGINT) AS error FROM n2 n JOIN kept k USING (r) GROUP BY k.r, k.vec_id, k.label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded
"""
_NEAREST_SQL = """
n{i} AS (
  SELECT x.r, x.p, min({{'away': (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) + (x.d - y.d) * (x.d - y.d), 'e': y.e}}) AS at
  FROM parts x JOIN b{i} y USING (p) GROUP BY x.r, x.p),"""
_MEAN_SQL = "coalesce((m.{c} - ((m.{c} % m.n + m.n) % m.n)) // m.n, o.{c}) AS {c}"
_MOVED_SQL = """
b{j} AS (
  SELECT o.p, o.e, {means} FROM b{i} o
  LEFT JOIN (SELECT n.p, n.at.e AS e, count(*) AS n, CAST(sum(x.a) AS BIGINT) AS a, CAST(sum(x.b) AS BIGINT) AS b, CAST(sum(x.c) AS BIGINT) AS c, CAST(sum(x.d) AS BIGINT) AS d FROM n{i} n JOIN parts x USING (r, p) GROUP BY n.p, n.at.e) m ON m.p = o.p AND m.e = o.e),"""


def codes_sql() -> str:
    means = ", ".join(_MEAN_SQL.format(c=c) for c in "abcd")
    rounds = "".join(_NEAREST_SQL.format(i=i) + (_MOVED_SQL.format(i=i, j=i + 1, means=means) if i < 2 else "") for i in range(3))
    return CODES_SQL.format(rounds=rounds)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(html) AS h FROM p),
g AS (SELECT *, [CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT) for i in range(8)] AS bits FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(flatten([[b >> 15, (b >> 10) & 31, (b >> 5) & 31, b & 31] for b in bits]), lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM g
"""

#: The recursion holds each conversation's states in one list: [nothing, s, u, a], null where none is reached.
REPAIR_SQL = """
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], [CAST('0x' || substr(hex(key), CAST(2 * i + 1 AS INT), 2) AS UBIGINT) for i in range(octet_length(key))]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS UBIGINT) for k in range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hurt FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, hurt, unnest(CASE WHEN hurt = 3 THEN [0, 1] ELSE [0] END) AS again FROM crc),
bare AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt WHERE hurt <> 0),
r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM bare),
ends AS (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id),
walk(conv_id, i, s, one) AS (
  SELECT conv_id, CAST(0 AS BIGINT), s, {'c': c, 'a': a} FROM ends, (VALUES (0, CAST(0 AS BIGINT), ''), (2, 5, 'I'), (3, 10, 'II')) v(s, c, a)
  UNION ALL
  SELECT conv_id, i, s, min({'c': c, 'a': a}) FROM (
    SELECT conv_id, i, unnest(CASE s WHEN 2 THEN [2, 3] WHEN 3 THEN [3, 2] ELSE [s, 2, 3] END) AS s, unnest(CASE WHEN s >= 2 THEN [c, c + 5] ELSE [c, c + 5, c + 10] END) AS c, unnest(CASE WHEN s >= 2 THEN [a, a || 'I'] ELSE [a, a || 'I', a || 'II'] END) AS a
    FROM (
      SELECT w.conv_id, r.i, w.s, w.one.c + 2 AS c, w.one.a || 'D' AS a FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, r.i, CASE w.s WHEN 2 THEN 3 ELSE 2 END, w.one.c + 1 + 5 * CAST(fault = 't' AS INT), w.one.a || 'R' FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 WHERE fault IN ('', 't')
      UNION ALL
      SELECT w.conv_id, r.i, CASE f WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, w.one.c + 5 * CAST(fault = 't' AS INT), w.one.a || 'K' FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
      WHERE fault IN ('', 't') AND (f = 's' AND w.s = 0 OR f = 'u' AND w.s IN (0, 1, 3) OR f = 'a' AND w.s = 2))
  ) GROUP BY conv_id, i, s),
best AS (SELECT w.conv_id, min(w.one) AS one FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.i WHERE w.s IN (0, 3) GROUP BY w.conv_id),
edits AS (SELECT conv_id, k, substr(one.a, k, 1) AS e, k - len(replace(substr(one.a, 1, k), 'I', '')) AS inserted, k - len(replace(substr(one.a, 1, k), 'D', '')) AS deleted FROM (SELECT conv_id, one, unnest(range(1, len(one.a) + 1)) AS k FROM best)),
kept AS (SELECT e.conv_id, e.k, e.e, e.k - e.deleted AS place, r.role, CASE WHEN e.e = 'I' THEN '' ELSE r.text END AS text FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.k - e.inserted AND e.e <> 'I' WHERE e.e <> 'D'),
led AS (SELECT conv_id, max(CAST(place = 1 AND e = 'K' AND left(role, 1) = 's' AS INT)) AS led FROM kept GROUP BY conv_id),
mended AS (
  SELECT k.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole
  FROM kept k JOIN led l ON l.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || f NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.one.c, 0) AS BIGINT) AS cost, coalesce(b.one.a, '') AS audit, sha256(coalesce(m.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_threshold_topk": TOPK_SQL, "op11_vector_codes": codes_sql(), "op12_warc_archive": WARC_SQL, "op13_conversation_repair": REPAIR_SQL}
