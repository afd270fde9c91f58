"""Language spans: scripts narrow candidates, word scores are smoothed by a Viterbi path.

The model holds hashed letter n-grams of a bounded sample of labelled training rows.  A word's
score for a language is its mean n-gram log-probability; a text's words are labelled by the best
path where each change of language costs ``penalty``, and the language of most letters wins.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow
from foldlattice.llm.textblocks import slices

#: Rows a language that the model is fitted on, in expectation, and words that are counted at a time.
SAMPLE_ROWS = 3_000
RUN = 50_000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")
#: Script ranges (fixed values: Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F), ("thai", 0x0E00, 0x0E7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, low, high in SCRIPTS if low <= c <= high), "other")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of words between their edges, and the word that each belongs to."""
    codes = np.frombuffer(f"<{'><'.join(words)}>".lower().encode("utf-32-le"), dtype=np.uint32)
    word = np.cumsum(codes == ord("<")) - 1
    buckets, owners = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        inside = word[:m] == word[n - 1 :] if m > 0 else np.zeros(0, dtype=bool)
        h = np.full(int(inside.sum()), 2166136261, dtype=np.uint32)
        at = np.flatnonzero(inside)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint32(16777619)
        buckets.append((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS))
        owners.append(word[at])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """``table[bucket, language]`` log-probabilities, and which scripts a language was seen in."""

    languages: list[str]
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    known: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Mean n-gram log-probability times the root of the length; languages without the word's script fall far behind."""
        bucket, owner = grams(words)
        n = len(words)
        own = np.stack([np.bincount(owner, self.table[bucket, k], n) for k in range(len(self.languages))], axis=1)
        own *= (np.sqrt([len(w) for w in words]) / np.bincount(owner, minlength=n))[:, None]
        masks = [self.scripts.get(script(w)) for w in words]
        for i, mask in enumerate(masks):
            if mask is not None and not mask.all():
                own[i, ~mask] = own[i].min() - 20.0
        return own

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row a word; words are remembered by a worker up to a bound."""
        missing = list(set(words).difference(self.known))
        if self.rows is None or len(self.known) + len(missing) > len(self.rows):
            self.known.clear()
            missing = list(set(words))
            self.rows = np.zeros((max(REMEMBERED, len(missing)), len(self.languages)), dtype=np.float32)
        if missing:
            at = len(self.known)
            self.rows[at : at + len(missing)] = self.score(missing)
            self.known.update(zip(missing, range(at, at + len(missing))))
        return self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word where a change costs ``penalty``.

    A constant path is best if no other language gains more than half a change's cost over any run
    of words, since m runs take m - 1 changes at least; that is seen from running sums, and only
    other texts are walked word by word.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum(np.minimum.accumulate(np.vstack((np.zeros((1, k)), gain[:-1])), axis=0), 0)
    if (gain - low).max() <= penalty / 2:
        return np.full(n, best)
    state, back = scores[0].copy(), np.zeros((n, k), dtype=np.int32)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(state.argmax())
        moved = state[top] - penalty
        back[i] = np.where(state >= moved, stay, top)
        state = np.maximum(state, moved) + scores[i]
    path = np.empty(n, dtype=np.int32)
    path[-1] = int(state.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> Model:
    """The model of ``rows`` whole rows a language at most, in expectation, chosen by the hash of their ids.

    Repeated rows count each time; rows without a text or a language teach nothing.  The n-gram counts are
    summed by Spark; the driver gets no more than ``BUCKETS`` counts a language.
    """
    own = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("id"))
    share = own.groupBy("lang").agg(F.count("*").alias("n"))
    cut = {r["lang"]: r["n"] for r in share.collect()}  # one row a language
    limit: Column = F.lit(None)
    for lang, n in cut.items():
        limit = F.when(F.col(lang_col) == lang, F.lit(min(1.0, rows / n))).otherwise(limit)
    sample = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < limit * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                words = WORD.findall(text)
                for at in range(0, len(words), RUN):
                    own += np.bincount(grams(words[at : at + RUN])[0], minlength=BUCKETS)
                seen.update((lang, script(w)) for w in words)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at]), pa.array([None] * len(at), pa.string())], ["lang", "bucket", "n", "script"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in seen]), pa.array([-1] * len(seen)), pa.array([1] * len(seen)), pa.array([s[1] for s in seen])], ["lang", "bucket", "n", "script"])

    counted = sample.transform(in_arrow, count, "lang string, bucket long, n long, script string").groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cut)
    table = np.full((BUCKETS, len(languages)), 0.2)
    scripts: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        grams_of = own[own["bucket"] >= 0]
        table[grams_of["bucket"].to_numpy(dtype=np.int64), k] += grams_of["n"].to_numpy()
        for name in own["script"].dropna():
            scripts.setdefault(name, np.zeros(len(languages), dtype=bool))[k] = True
    return Model(languages, np.log(table / table.sum(axis=0)), scripts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred, score, spans``: label, its share of the letters, and (language, first word, words) spans.

    ``und`` with score 0 and no spans if a text is null or has no letters, or nothing was learned.  Of
    languages with equally many letters the first by name is taken; repeated rows are labelled alike.
    """
    sc = docs.sparkSession.sparkContext
    key = uuid.uuid4().hex  # a reused worker keeps the model of one call
    shared = sc.broadcast((model.languages, model.table.astype(np.float32), model.scripts))  # BUCKETS rows, whatever the input
    own = docs.select(*keep, F.col(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _LOADED.get(key)
        if m is None:
            _LOADED.clear()
            m = _LOADED[key] = Model(*shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in slices([len(t or "") for t in texts]):
                found, score, spans = [], [], []
                all_words = [WORD.findall(text) if text else [] for text in texts[part]]
                flat = m.word_scores([w for words in all_words for w in words]) if m.languages and any(all_words) else None
                at = 0
                for words in all_words:
                    at += len(words)
                    if not words or not m.languages:
                        found.append("und"), score.append(0.0), spans.append([])
                        continue
                    path = viterbi(flat[at - len(words) : at].astype(np.float64), penalty)
                    letters = np.bincount(path, weights=np.fromiter(map(len, words), dtype=np.float64, count=len(words)), minlength=len(m.languages))
                    top = int(letters.argmax())
                    edges = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]))
                    found.append(m.languages[top]), score.append(float(letters[top] / letters.sum()))
                    spans.append([{"lang": m.languages[path[b]], "first": int(b), "words": int(e - b)} for b, e in zip(edges, edges[1:])])
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array(score), pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))], [*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    return own.transform(in_arrow, work, f"{schema}, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long>>")


_LOADED: dict[str, Model] = {}
