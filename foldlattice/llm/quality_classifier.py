"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model.

One model a language is trained on trusted rows, ``rows`` of them at most in expectation, chosen by
the hash of their ids.  Its counts, continuation counts, discounts and back-off weights are sharded group-bys
and joins on the words' keys.  The finished table is bounded by the sample and is what scoring tasks
look up; a document passes if its perplexity is no higher than its language's ``share`` quantile
over trusted rows that were not trained on, and nothing else.  Each text is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, named, stored
from foldlattice.llm.lm_scoring import bigram_keys, histories, tokens_of
from foldlattice.llm.textblocks import U64, mix, slices

#: Trusted rows a language that are trained on; the quantile of the perplexities of all others is the limit.
ROWS = 600
SHARE = 0.999
#: Steps of the logarithm of perplexity in which its quantiles are counted.
BIN = 0.01
ANY = "*"
WORDY = r"[^\x20\x09-\x0D]"


def _lang_key(lang: str) -> np.uint64:
    h = 1469598103934665603
    for b in lang.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([h], dtype=np.uint64))[0]


def _word_bigrams(trusted: DataFrame) -> DataFrame:
    """``lang, v, w, n``: bigram counts of trusted texts by language and over all languages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices([len(t or "") for t in texts]):
                tokens, starts = tokens_of(texts[part])
                before, lang = histories(tokens, starts), np.repeat(np.array(langs[part], dtype=object), np.diff(starts))
                for name in set(langs[part]):
                    own = lang == name
                    pairs = np.stack((before[own], tokens[own]), axis=1)
                    distinct, n = np.unique(pairs, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct)), pa.array(distinct[:, 0].view(np.int64)), pa.array(distinct[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "v", "w", "n"])

    counted = trusted.select("lang", "text").transform(in_arrow, work, "lang string, v long, w long, n long")
    return counted.unionByName(counted.withColumn("lang", F.lit(ANY))).groupBy("lang", "v", "w").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, n: str) -> DataFrame:
    """``lang, d1, d2, d3``: modified Kneser-Ney discounts from counts of counts."""
    t = [F.greatest(F.count_if(F.col(n) == k), F.lit(1)).alias(f"t{k}") for k in (1, 2, 3, 4)]
    of = counts.groupBy("lang").agg(*t)
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    d = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"))).alias(f"d{k}") for k in (1, 2, 3)]
    return of.select("lang", *d)


def _discount(n: str) -> Column:
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(trusted: DataFrame) -> DataFrame:
    """``lang, kind, v, w, p`` of ``trusted`` (lang, text).

    kind 2: interpolated p(w | v); kind 1: lower-order p(w); kind 0: the weight of v's lower order
    (v of a word), or of an unknown word (v null).  What several parts of it need is written once, so
    that no plan holds it again and again; the driver's memory grows with the exchanges that it plans.
    """
    bigrams = stored(_word_bigrams(trusted), "bigrams")
    follow = stored(bigrams.groupBy("lang", "w").agg(F.count("*").alias("before")), "follow")
    low_d = stored(_discounts(follow, "before"), "discounts")
    sizes = stored(follow.join(F.broadcast(low_d), "lang").groupBy("lang").agg(F.sum("before").alias("all"), F.count("*").alias("words"), F.sum(_discount("before")).alias("mass")), "sizes")  # a row a language
    lower = follow.join(F.broadcast(low_d), "lang").join(F.broadcast(sizes), "lang")
    unknown = F.col("mass") / F.col("all") / (F.col("words") + 1)
    lower = lower.select("lang", "w", ((F.col("before") - _discount("before")) / F.col("all") + unknown).alias("p_low"))
    with_d = bigrams.join(F.broadcast(stored(_discounts(bigrams, "n"), "discounts")), "lang")
    weights = stored(with_d.groupBy("lang", "v").agg(F.sum("n").alias("held"), (F.sum(_discount("n")) / F.sum("n")).alias("weight")), "weights")
    high = with_d.join(weights, ["lang", "v"]).join(lower, ["lang", "w"]).select("lang", F.lit(2).alias("kind"), "v", "w", ((F.col("n") - _discount("n")) / F.col("held") + F.col("weight") * F.col("p_low")).alias("p"))
    none = F.lit(None).cast("long")
    return (
        high.unionByName(lower.select("lang", F.lit(1).alias("kind"), none.alias("v"), "w", F.col("p_low").alias("p")))
        .unionByName(weights.select("lang", F.lit(0).alias("kind"), "v", none.alias("w"), F.col("weight").alias("p")))
        .unionByName(sizes.select("lang", F.lit(0).alias("kind"), none.alias("v"), none.alias("w"), unknown.alias("p")))
    )


def _tables(model: DataFrame) -> tuple[dict[str, float], list[np.ndarray], list[np.ndarray]]:
    """Unknown-word probabilities, and sorted keys and log-probabilities of kinds 0, 1, 2.

    Bounded by the training sample's tokens, whatever the corpus; keys are made in the tasks.  The
    driver holds a copy of a column at a time beside the rows that it got and what it returns.
    """
    whole = F.col("v").isNull() & F.col("w").isNull()
    unknown = {r["lang"]: r["p"] for r in model.where(whole).select("lang", "p").collect()}  # a row a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            names = rows["lang"].combine_chunks().dictionary_encode()
            salt = np.array([_lang_key(x) for x in names.dictionary.to_pylist()] or [0], dtype=np.uint64)[names.indices.to_numpy(zero_copy_only=False)] if len(rows) else np.zeros(0, dtype=np.uint64)
            kinds = rows["kind"].to_numpy()
            v, w = (rows[c].fill_null(0).to_numpy().view(np.uint64) for c in ("v", "w"))
            key = np.where(kinds == 2, bigram_keys(v, w) + salt, mix(np.where(kinds == 1, w, v) + salt))
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int8)), pa.array(key.view(np.int64)), pa.array(np.log(rows["p"].to_numpy()).astype(np.float32))], ["kind", "key", "log_p"])

    rows = model.where(~whole).select("lang", "kind", "v", "w", "p").transform(in_arrow, work, "kind byte, key long, log_p float").toArrow()
    kinds, key, log_p = (rows[c].to_numpy() for c in ("kind", "key", "log_p"))
    del rows
    pa.default_memory_pool().release_unused()
    keys, logs = [], []
    for kind in (0, 1, 2):
        own = kinds == kind
        part, values = key[own].view(np.uint64), log_p[own]
        if kind == 2:
            del kinds, key, log_p, own
        order = np.argsort(part)
        keys.append(part[order])
        logs.append(values[order])
        del part, values, order
    return unknown, keys, logs


def _look(keys: np.ndarray, logs: np.ndarray, wanted: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, dtype=np.float64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, logs[at], missing)


def perplexities(docs: DataFrame, shared: Broadcast, keep: list[str], model_col: str, text_col: str = "text") -> DataFrame:
    """``keep`` and ``model_lang, n_tokens, perplexity`` of each whole text (null: its end alone) under the model named.

    ``shared`` holds the result of ``_tables``.  A name without a model stands for the one over all languages.
    """
    own = docs.select(*keep, F.col(model_col).alias("model_"), F.col(text_col).alias("text_"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[: len(keep)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown, keys, logs = shared.value
        salts = {lang: _lang_key(lang) for lang in unknown}
        for batch in batches:
            names, texts = (batch.column(len(keep) + k).to_pylist() for k in (0, 1))
            for part in slices([len(t or "") for t in texts]):
                model = [x if x in unknown else ANY for x in names[part]]
                tokens, starts = tokens_of(texts[part])
                n = np.diff(starts)
                value = np.ones(len(n))
                if unknown:
                    before = histories(tokens, starts)
                    salt = np.repeat(np.array([salts[x] for x in model], dtype=np.uint64), n)
                    floor = np.repeat(np.log([unknown[x] for x in model]), n)
                    low = _look(keys[1], logs[1], mix(tokens + salt), floor)
                    back = _look(keys[0], logs[0], mix(before + salt), 0.0) + low
                    log_p = _look(keys[2], logs[2], bigram_keys(before, tokens) + salt, back)
                    value = np.exp(-np.add.reduceat(log_p, starts[:-1]) / n)
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model), pa.array(n.astype(np.int64)), pa.array(value)], [*keep, "model_lang", "n_tokens", "perplexity"])

    return own.transform(in_arrow, work, f"{schema}model_lang string, n_tokens long, perplexity double")


def _limits(scored: DataFrame, share: float) -> dict[str, float]:
    """Each model's limit from all rows of ``scored`` (model_lang, perplexity): a row a language reaches the driver."""
    bins = scored.groupBy("model_lang", F.ceil(F.log("perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    own_lang = W.partitionBy("model_lang")
    upto = bins.withColumn("upto", F.sum("n").over(own_lang.orderBy("bin"))).withColumn("all", F.sum("n").over(own_lang))
    limits = upto.where(F.col("upto") >= share * F.col("all")).groupBy("model_lang").agg(F.exp(F.min("bin") * BIN).alias("limit"))
    return {r["model_lang"]: r["limit"] for r in limits.collect()}


def _among(column: Column, names: list[str]) -> Column:
    return column.isin(names) if names else F.lit(False)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, share: float = SHARE, prefix: str = "") -> DataFrame:
    """The rows and columns of ``docs`` with ``perplexity, perplexity_limit, kept`` behind them, their names after ``prefix``.

    Columns of ``docs`` that have one of these three names give way; others may have any name.

    ``labels`` (doc_id, quality, toxic): trusted are rows of quality 1 that aren't toxic.  A null
    language, and one without trusted rows on both sides, have the model over all languages and its
    limit, which all trusted rows that were not trained on set.  If no trusted row is left on one
    side, all are used on both.  Without trusted rows that hold a word, all texts with a word are
    kept; a text without words (or null) is rejected.  Repeated ids are judged row by row.  Texts are scored
    whole, however long; a text exactly at the limit is kept; an empty table gives no rows.

    Every text is scored once, and its number is kept by its id and the hash of its text and language;
    texts are scored again, by the model over all languages, only where a document is judged by that one.
    """
    key = F.xxhash64(F.coalesce(text_col, F.lit("")), F.coalesce(lang_col, F.lit(ANY)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(ANY)).alias("lang"), key.alias("h"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id")).distinct()
    wordy = F.rlike("text", F.lit(WORDY))
    good = stored(good, "trusted_ids")
    known = stored(own.select("doc_id", "lang", wordy.alias("wordy")).join(good, "doc_id", "left_semi"), "known")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    part: Column = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * rows / n))).otherwise(part)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sampled = F.coalesce(u < part, F.lit(False))
    train = sampled & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0)
    wordy = own.where(wordy)
    sides = known.where("wordy").select("lang", train.alias("train")).groupBy("lang").agg(F.count_if("train").alias("trained"), F.count_if(~F.col("train")).alias("held")).collect()  # a row a language
    both = all(sum(r[side] for r in sides) for side in ("trained", "held"))
    if not both:  # no more than a few trusted rows
        train = sampled
    judged = [r["lang"] for r in sides if r["lang"] != ANY and (not both or r["trained"] and r["held"])]
    held = ~train if both else train
    tables = _tables(stored(kneser_ney(stored(wordy.where(train).join(good, "doc_id", "left_semi").select("lang", "text"), "trusted")), "model"))
    modelled = bool(tables[0])
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # bounded: see _tables
    del tables
    judge = F.when(_among(F.col("lang"), judged), F.col("lang")).otherwise(F.lit(ANY))
    scored = stored(perplexities(own.withColumn("judge", judge), shared, ["doc_id", "h", "lang"], "judge"), "scored")
    trusted = scored.where((F.col("n_tokens") > 1) & held).join(good, "doc_id", "left_semi")
    limits = _limits(trusted.where(F.col("model_lang") != ANY), share) if modelled else {}
    if modelled and scored.where(F.col("model_lang") == ANY).limit(1).count():
        again = perplexities(wordy.where(held & _among(F.col("lang"), judged)).withColumn("judge", F.lit(ANY)), shared, ["doc_id"], "judge").join(good, "doc_id", "left_semi")
        limits |= _limits(trusted.where(F.col("model_lang") == ANY).select("model_lang", "perplexity").unionByName(again.select("model_lang", "perplexity")), share)
    shared.destroy()  # all that needs it is written or collected
    limit: Column = F.lit(None).cast("double")
    for lang, most in limits.items():
        limit = F.when(F.col("model_lang") == lang, F.lit(most)).otherwise(limit)
    fits = limit.isNull() | (F.col("perplexity") <= limit)
    verdicts = scored.select("doc_id", "h", F.struct("perplexity", limit.alias("limit"), ((F.col("n_tokens") > 1) & fits).alias("kept")).alias("v")).groupBy("doc_id", "h").agg(F.first("v").alias("v"))
    added = [f"{prefix}{name}" for name in ("perplexity", "perplexity_limit", "kept")]
    kept = [c for c in docs.columns if c not in added]
    # inside, all columns go by their places: a caller's names can't clash
    inner = [f"_{i}" for i in range(len(kept))]
    facing = docs.select(*[named(c).alias(i) for c, i in zip(kept, inner)], F.col(id_col).alias("id_"), key.alias("h_"))
    met = facing.join(verdicts, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("h_") == F.col("h")))
    return met.select(*[F.col(i).alias(c) for c, i in zip(kept, inner)], F.col("v.perplexity").alias(added[0]), F.col("v.limit").alias(added[1]), F.col("v.kept").alias(added[2]))
