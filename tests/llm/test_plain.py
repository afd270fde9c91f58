"""Operators against plain versions of their models, and cases that single rows can break."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldlattice.llm import language_id as L
from foldlattice.llm import quality_rules as QR
from foldlattice.llm.lm_scoring import backoff_automaton
from foldlattice.llm.packing import SumIndex
from foldlattice.llm.quality_classifier import quality_classifier
from foldlattice.llm.registry import queries
from foldlattice.llm.textblocks import Words
from foldlattice.llm.wavelet import new_shard_folder, open_shard, read_documents, write_shards

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney bigrams: a function from text to perplexity."""
    two = collections.Counter(p for t in texts for p in zip(["<", *words(t)], [*words(t), ">"]))
    one = collections.Counter(w for _, w in two)

    def discounts(counts):
        t = {k: max(1, sum(c == k for c in counts.values())) for k in (1, 2, 3, 4)}
        y = t[1] / (t[1] + 2 * t[2])
        d = [max(0.05, min(k - 0.05, k - (k + 1) * y * t[k + 1] / t[k])) for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    low_d, high_d = discounts(one), discounts(two)
    total = sum(one.values())
    floor = sum(map(low_d, one.values())) / total / (len(one) + 1)
    low = {w: (c - low_d(c)) / total + floor for w, c in one.items()}
    held, cut = collections.Counter(), collections.Counter()
    for (v, _), c in two.items():
        held[v] += c
        cut[v] += high_d(c)

    def p(v, w):
        rest = low.get(w, floor)
        if v not in held:
            return rest
        c = two.get((v, w), 0)
        return (c - high_d(c) if c else 0) / held[v] + cut[v] / held[v] * rest

    def perplexity(text):
        w = [*words(text), ">"]
        return math.exp(-sum(math.log(p(a, b)) for a, b in zip(["<", *w], w)) / len(w))

    return perplexity


def test_perplexities(spark, rows):
    own = [(i, t, "en") for i, t, *_ in rows if i < 40] + [(100 + i, t, None) for i, t, *_ in rows if 40 <= i < 50] + [(i, t, "en") for i, t, *_ in rows if i >= 200]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    trained = {r["doc_id"] for r in docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < 1 << 20) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0) & (F.col("doc_id") < 40)).collect()}
    labels = docs.where("doc_id < 40").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    plain = plain_kneser_ney([t for i, t, _ in own if i in trained])
    got = quality_classifier(docs, labels).collect()
    assert 5 < len(trained) < 35 and len(got) == len(own)
    texts = {i: t for i, t, _ in own}
    for r in got:
        assert r["perplexity"] == pytest.approx(plain(texts[r["doc_id"]]), rel=1e-5), r["doc_id"]


def test_columns_named_like_those_inside(spark, docs, rows):
    odd = docs.select("doc_id", "text", "lang", *[F.lit("x").alias(c) for c in ("perplexity", "model_lang", "judge", "most", "kept", "_0", "__lang", "general", "v", "w")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)], "doc_id long, quality int, toxic int")
    got = quality_classifier(odd, labels)
    assert got.columns == [*[c for c in odd.columns if c not in ("perplexity", "kept")], "perplexity", "perplexity_limit", "kept"]
    assert {r["kept"] for r in got.collect()} == {True, False}
    beside = quality_classifier(odd, labels, prefix="judged_")
    assert beside.columns == [*odd.columns, "judged_perplexity", "judged_perplexity_limit", "judged_kept"]
    assert {(r["kept"], r["perplexity"]) for r in beside.collect()} == {("x", "x")}


def plain_outliers(rows, share=0.75, steps=12):
    """The verdict of a minimum-covariance-determinant fit of one group, from medians on."""
    x = np.array(rows)
    p, floors = x.shape[1], np.array(QR.FLOORS)
    factor = share / QR.chi2_cdf(QR.chi2_quantile(share, p), p + 2)

    def up(values, q):
        binned = np.sort(np.ceil(values / QR.BIN - 1e-12))
        return binned[math.ceil(q * len(binned)) - 1] * QR.BIN

    centre = np.array([up(x[:, i], 0.5) for i in range(p)])
    scale = np.diag(np.array([(1.4826 * up(abs(x[:, i] - centre[i]), 0.5)) ** 2 for i in range(p)]) + floors**2)
    for _ in range(steps):
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scale), x - centre)
        near = x[np.log(d2 + 1e-9) <= up(np.log(d2 + 1e-9), share)]
        before, centre = centre, near.mean(axis=0)
        scale = np.cov(near.T, bias=True) * factor + np.diag(floors**2)
        if np.abs(before - centre).max() < 1e-6:
            break
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scale), x - centre)


def test_robust_distances(spark):
    rng = random.Random(5)
    texts = []
    for i in range(300):
        junk = i % 15 == 0
        line = " ".join("x" * rng.randint(2, 7) + str(rng.randrange(10**6)) + ("#$" if junk or rng.random() < 0.03 else "") for _ in range(60))
        texts.append((i, line + ("\n" + line[:40] + "\n" + line[:40] if rng.random() < 0.2 else ""), "en", "a"))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in QR.quality_rules(df).collect()}
    feats = []
    for i, t, *_ in texts:
        r, lines = got[i], [x for x in t.split("\n") if x.strip()]
        feats.append((math.log(r["word_chars"] / r["n_words"]), math.sqrt(r["n_symbols"] / (r["word_chars"] + r["n_symbols"])), math.sqrt(r["n_dup_lines"] / len(lines)), math.sqrt(r["n_repeat_words"] / r["n_words"])))
    d2 = plain_outliers(feats)
    limit = QR.chi2_quantile(1 - 1e-6, 4)
    far = np.abs(np.log(d2 / limit)) > 0.2  # bins and stopping rules differ near the limit
    assert far.sum() > 280 and {bool(d > limit) for d in d2} == {True, False}
    for i in np.flatnonzero(far):
        assert got[i]["kept"] == (d2[i] <= limit) and not got[i]["base_failed"]
        assert got[i]["d2"] == pytest.approx(d2[i], rel=0.15, abs=0.05)


def test_windows_of_a_very_long_text(spark):
    n = 4_000_000
    text = "a b c " + " ".join(map(str, range(n))) + " a b c"
    got = QR.quality_rules(spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")).first()
    assert (got["n_words"], got["n_repeat_words"]) == (n + 6, 6)


def test_languages_by_plain_paths(spark, rows):
    docs = spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string, source string")
    model = L.fit(docs.where("doc_id < 100"))
    mixed = [(i, " ".join((t or "").split()[:4] + (u or "").split()[:3])) for i, ((_, t, *_), (_, u, *_)) in enumerate(zip(rows[:12], rows[12:24]))]
    got = {r["doc_id"]: r for r in L.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model, penalty=3.0).collect()}
    for i, text in mixed:
        own = re.findall(r"[^\W\d_]+", text)
        k = len(model.languages)
        scores = np.zeros((len(own), k))
        for at, w in enumerate(own):
            grams = [f"<{w}>".lower()[b : b + n] for n in L.ORDERS for b in range(len(w) + 3 - n)]
            for lang in range(k):
                h = []
                for g in grams:
                    x = 2166136261
                    for c in g:
                        x = (x ^ ord(c)) * 16777619 & 0xFFFFFFFF
                    h.append((x ^ x >> 15) % L.BUCKETS)
                scores[at, lang] = math.sqrt(len(w)) * np.mean([model.table[b, lang] for b in h])
        best = max(itertools.product(range(k), repeat=len(own)), key=lambda path: sum(scores[a, s] for a, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:])))
        letters = collections.Counter()
        for w, s in zip(own, best):
            letters[model.languages[s]] += len(w)
        r = got[i]
        assert [(s["lang"], s["words"]) for s in r["spans"]] == [(model.languages[s], len(list(g))) for s, g in itertools.groupby(best)]
        assert r["lang_pred"] == min(letters, key=lambda x: (-letters[x], x)) and r["score"] == pytest.approx(letters[r["lang_pred"]] / sum(letters.values()))


def test_language_of_a_long_training_text(spark):
    late = " ".join(["alpha beta"] * 60_000 + ["qzqz qzqzx"] * 60_000)
    model = L.fit(spark.createDataFrame([(1, late, "aa"), (2, "gamma delta " * 40, "bb")], "doc_id long, text string, lang string"))
    got = L.predict(spark.createDataFrame([(3, "qzqz qzqzx qzqz"), (4, "gamma gamma")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["aa", "bb"]
    at = np.unique(L.grams(["qzqz"])[0])
    assert (np.exp(model.table[at, 0]) > np.exp(model.table[at, 1])).mean() > 0.9


def test_ids_repeated_over_a_shard_edge(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (7, text + " more"), (9, "x"), (9, "x")], "doc_id long, text string").coalesce(1)
    path = new_shard_folder(docs)
    write_shards(docs, VOCABULARY, path, tokens=50)
    shards = spark.read.parquet(path)
    assert shards.count() >= 3
    got = sorted(read_documents(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [7, 7, 7, 9, 9]
    assert [r["start"] for r in got] == list(itertools.accumulate([0] + [r["n_tokens"] for r in got[:-1]]))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    # a written shard answers by its planes alone
    for row in shards.collect():
        m = open_shard(row.asDict())
        ids = m.decode()
        for token in {int(ids[0]), int(ids[-1]), 0}:
            places = np.flatnonzero(ids == token).tolist()
            assert m.count(token) == len(places) and m.occurrences(token) == places and m.access(len(ids) - 1) == ids[-1]


def test_walk_follows_failure_arcs():
    rng = np.random.default_rng(3)
    n, mu = 6, 2.0
    p = rng.dirichlet(np.ones(n))
    held = np.concatenate(([0], rng.integers(1, 9, n + 1))).astype(float)
    history, symbol = (x.ravel() for x in np.meshgrid(np.arange(1, n + 2), np.arange(n), indexing="ij"))
    counts = rng.integers(0, 3, len(history))
    a = backoff_automaton(p, held, history, symbol, counts, mu)
    texts = [rng.integers(0, n, k).tolist() for k in (1, 5, 3, 9, 1)]
    got = a.walk(np.concatenate(texts).astype(np.int64), np.cumsum([0, *map(len, texts)]), 1)
    for text, value in zip(texts, got):
        state, want = 1, 0.0
        for w in text:
            c = counts[(history == state) & (symbol == w)][0]
            want += math.log10((c + mu * p[w]) / (held[state] + mu)) if c else math.log10(mu / (held[state] + mu)) + math.log10(p[w])
            state = w + 2
        assert value == pytest.approx(want)


@pytest.mark.parametrize("seed", range(5))
def test_sum_index(seed):
    rng = random.Random(seed)
    free = [0] * 41
    for _ in range(12):
        free[rng.randrange(1, 40)] += rng.randint(1, 3)
    index = SumIndex(free)
    while any(free):
        gap, most = rng.randrange(1, 40), 40
        held = [n for n, c in enumerate(free) for _ in range(min(c, 3))]
        for size, kind in enumerate((index.singles, index.pairs, index.triples), 1):
            fresh = {tuple(sorted(c, reverse=True)) for c in itertools.combinations(held, size) if sum(c) == gap}
            index.third[gap] = 0  # sums are asked again here with other counts
            got = kind(gap, most)
            assert (got is None) == (not fresh) and (got is None or tuple(sorted(got, reverse=True)) in fresh)
        n = rng.choice([n for n, c in enumerate(free) if c])
        free[n] -= 1


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_registered_queries(spark, library):
    """The digests of the registered queries over a whole table, from the contract's words."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts.items()}
    at, two = 0, {}
    for i in sorted(ids):
        two[i] = (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    q = queries()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q["op2_wavelet_shards"](spark, SF).collect()} == two
    placed = q["op3_best_fit_packing"](spark, SF).collect()
    parts = collections.defaultdict(dict)
    for r in placed:
        parts[r["doc_id"]][r["piece"]] = r
    for i, own in ids.items():
        edges = [0, *range((len(own) - 1) % 2048 + 1, len(own) + 1, 2048)]
        assert [(parts[i][k]["start"], parts[i][k]["length"], parts[i][k]["ids_crc32"]) for k in range(len(parts[i]))] == [(b, e - b, zlib.crc32(own[b:e].tobytes())) for b, e in zip(edges, edges[1:])]
    fill = collections.defaultdict(list)
    for r in placed:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 2048
    assert len(fill) <= 1.02 * math.ceil(sum(map(len, ids.values())) / 2048) + 1
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for i in train for w in [*words(texts[i]), None])
    n = sum(c.values())
    for r in q["op4_backoff_lm"](spark, SF).collect():
        w = [*words(texts[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in set(train), len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w))
    held = [r for r in q["op9_language_id"](spark, SF).collect()]
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in held) and len(held) == len(texts)
    outside = [r for r in held if r["held_out"] and langs[r["doc_id"]] and re.search(r"[^\W\d_]", texts[r["doc_id"]] or "")]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in outside]) >= 0.95
    judged = q["op6_kneser_ney_quality"](spark, SF).collect()
    assert {r["doc_id"] for r in judged} == set(texts)
    assert len(Words(["a b", None]).hashes) == 2
