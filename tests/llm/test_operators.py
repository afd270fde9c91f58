"""The ten operators against plain versions; nulls, blanks, long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
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

from foldlattice.llm import quality_rules as QR
from foldlattice.llm.common import components, training_hash
from foldlattice.llm.dedup import match_threshold, near_duplicates
from foldlattice.llm.encoding import ForcedCutBpe, LibraryEncoder, forced_cut_encoder, library_encoder, round_trip
from foldlattice.llm.language_id import fit, predict, viterbi
from foldlattice.llm.license_scan import PHRASES, SHARE, TEMPLATE_WORDS, TEMPLATES, Index, scan_licenses, words_of
from foldlattice.llm.lm_scoring import pack_keys, score_documents, unpack_counts, unpack_keys
from foldlattice.llm.packing import pack, plan
from foldlattice.llm.quality_classifier import BIN, kneser_ney, quality_classifier
from foldlattice.llm.topk_search import top_k
from foldlattice.llm.wavelet import DECODED, WaveletMatrix, new_shard_folder, read_documents, write_shards

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACED, (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def ids_of(library, rows):
    return {i: np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for i, t, *_ in rows}


# 1 near duplicates


def test_near_duplicates(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    assert sum(not k for *_, k in got.values()) > 20


def test_near_duplicates_of_nothing(empty, docs):
    assert near_duplicates(empty).count() == 0
    twice = docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0"))
    assert [r["component_id"] for r in near_duplicates(twice).collect()] == [0, 0]


def test_match_threshold():
    t = match_threshold(64, 85, 1e-6)
    tail = sum(math.comb(64, k) * 0.85**k * 0.15 ** (64 - k) for k in range(t))
    assert tail <= 1e-6 < tail + math.comb(64, t) * 0.85**t * 0.15 ** (64 - t)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for i in sorted(near):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = i
                stack += near[x]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 2 wavelet shards, 3 packing, 10 encoding


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 40, n).astype(np.uint16)
        m = WaveletMatrix.build(ids, 6)
        assert (m.decode() == ids).all()
        for token in (0, 3, 39, 63, 64):
            at = np.flatnonzero(ids == token)
            assert m.count(token) == len(at) and m.occurrences(token)[:50] == at.tolist()[:50]
            assert m.rank(token, n // 2) == (ids[: n // 2] == token).sum()
        for i in rng.integers(0, n, 20) if n else ():
            assert m.access(int(i)) == ids[i]
        with pytest.raises(IndexError):
            m.select(3, m.count(3))


def test_shards(spark, docs, ids_of, empty):
    path = new_shard_folder(docs)
    write_shards(docs, VOCABULARY, path)
    at = 0
    got = sorted(read_documents(spark.read.parquet(path)).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(ids_of)
    for r in got:
        want = np.append(ids_of[r["doc_id"]], 0).astype("<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(want) // 4, zlib.crc32(want), want)
        at += len(want) // 4
    path = new_shard_folder(empty)
    write_shards(empty, VOCABULARY, path)
    assert read_documents(spark.read.parquet(path)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
    made = plan(counts, 64)
    used = collections.Counter()
    for times, lengths in made:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    rooms = []  # plain best fit, longest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(64 - n)
    assert math.ceil(sum(n * c for n, c in counts.items()) / 64) <= sum(t for t, _ in made) <= len(rooms)


def test_packing(docs, ids_of, empty):
    rows = pack(docs, VOCABULARY, capacity=256).toPandas()
    for i, own in rows.groupby("doc_id"):
        own = own.sort_values("piece")
        want = np.append(ids_of[i], 0).astype("<u4")
        assert own["piece"].tolist() == list(range(len(own))) and (own["length"].iloc[1:] == 256).all()
        assert b"".join(own["ids"]) == want.tobytes() and own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert all(zlib.crc32(x) == c for x, c in zip(own["ids"], own["ids_crc32"]))
    assert set(rows["doc_id"]) == set(ids_of)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 256
    assert rows["sequence_id"].nunique() <= 1.1 * rows["length"].sum() / 256 + 1
    assert pack(empty, VOCABULARY).count() == 0


def test_encoding(docs, rows, ids_of, library, empty):
    got = {r["doc_id"]: r for r in round_trip(docs, VOCABULARY).collect()}
    assert len(got) == len(rows)
    for i, want in ids_of.items():
        assert bytes(got[i]["ids"]) == want.tobytes()
        assert got[i]["decoded"] == library.decode(want.tolist(), skip_special_tokens=False)
    assert round_trip(empty, VOCABULARY).count() == 0


def test_encoders_on_odd_texts(library):
    bpe, own = forced_cut_encoder(VOCABULARY)
    assert bpe.space_is_forced
    rng = random.Random(2)
    alphabet = "aàbeè  \n\t'’s.!,0٣½中か😀 ​Zß\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["a" * 3000, " " * 500 + "x", "ab" * 2000, "don't  we'll", "<|endoftext|>", "a<|endoftext|> b"]
    for encoder in (own, library_encoder(VOCABULARY)):
        for text, packed in zip(texts, encoder.packed_many(texts)):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_at_line_ends_are_remembered(library):
    """Words beside line ends and marks aren't remembered with each of their neighbours."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(30)]
    texts = ["\n".join(f"{rng.choice(words)}{rng.choice(['', '.', '***'])} x {rng.choice(words)}{rng.choice(['', '.', '$$$'])}" for _ in range(40)) for _ in range(50)]
    odd = ["".join(rng.choice(["ab", "É", "\n", "\n", " ", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2028", ".", "***", "'s", "7", "\0"]) for _ in range(rng.randint(1, 15))) for _ in range(3000)]
    encoder = LibraryEncoder(VOCABULARY)
    for text, packed in zip(texts, encoder.packed_many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 30 * 2 * 5
    for text, packed in zip(odd, encoder.packed_many(odd)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_decode_in_runs():
    for n in (DECODED - 1, DECODED, DECODED + 1, 2 * DECODED + 77):
        ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint16)
        assert (WaveletMatrix.build(ids, 16).decode() == ids).all()


def test_forced_pairs():
    bpe = ForcedCutBpe(VOCABULARY)
    inside = {(a, b) for t in bpe.token_bytes[:-1] for a, b in zip(t, t[1:])}
    assert {(i >> 8, i & 255) for i in np.flatnonzero(~bpe.forced)} == inside


# 4 language-model scores


def test_scores(docs, rows, empty):
    mu, train = 50.0, {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 10}
    one, two = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        w = [*words(t), None]
        if i in train:
            one.update(w)
            two.update(zip(["<", *w], w))
    starts = len(train)
    n, v = sum(one.values()), len(one)
    got = {r["doc_id"]: r for r in score_documents(docs, F.pmod(training_hash(F.col("doc_id")), F.lit(10)) != 0, mu=mu).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = [*words(t), None]
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        base = sum(map(math.log10, p))
        score = sum(math.log10((two[a, b] + mu * q) / ((starts if a == "<" else one[a]) + mu)) for a, b, q in zip(["<", *w], w, p))
        r = got[i]
        assert (r["training"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in train, len(w), sum(x in one for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    assert score_documents(empty, F.lit(True)).count() == 0


def test_packed_keys():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**56, n).astype(np.uint64))
        counts = rng.integers(0, 10 ** int(rng.integers(1, 12)), len(keys))
        packed = pack_keys(keys, counts)
        assert (unpack_keys(packed[0]) == keys).all() and (unpack_counts(packed[1], len(keys)) == counts).all()


# 5 licences


def test_licences(docs, rows, empty):
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        base = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(base), ",".join(sorted({x for _, x in base})))
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[207]["labels"] == "cc-by,cc-by-nc,mit"
    assert scan_licenses(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_all_notices_of_a_text(seed):
    rng = random.Random(seed)
    index = Index({w: rng.choice([0, 1, 40, 900]) for w in sorted({w for _, t, _ in TEMPLATE_WORDS for w in t})}, 1000)
    notices = [t for _, t, _ in TEMPLATES]
    for own in [notices, *(rng.sample(notices, k) for k in (1, 2, 2, 3, 6))]:
        text = words_of(" some words between ".join(own))
        for _ in range(rng.choice([0, 0, 5])):
            text[rng.randrange(len(text))] = b"changed"
        plain = []
        for (label, t, keys), total in zip(TEMPLATE_WORDS, index.total):
            for begin in range(-len(t) + 1, len(text)):
                score = sum(index.idf[w] for k, w in enumerate(t) if 0 <= begin + k < len(text) and text[begin + k] == w) / total
                part = b" ".join(text[max(begin, 0) : begin + len(t)])
                if score >= SHARE and any(b" " + b" ".join(k) + b" " in b" " + part + b" " for k in keys):
                    plain.append((label, max(begin, 0), min(begin + len(t), len(text)) - 1, score))
        assert index.scan(text) == plain
        assert b"changed" in text or {f[0] for f in plain} >= {label for label, t, _ in TEMPLATES if t in own}


# 6 quality classifier, 7 quality rules


def test_classifier(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(0, 1, 0), (500, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier(docs.drop("kept"), labels).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(120)) >= 110
    assert not any(got[i]["kept"] for i in (200, 201, 202))  # null, empty and blank
    assert got[208]["perplexity"] > got[5]["perplexity"]
    assert quality_classifier(empty.drop("kept"), labels).count() == 0
    none = quality_classifier(docs.drop("kept"), labels.where("quality = 0"))
    assert none.where("kept").count() == len(rows) - 3


def test_limits_of_languages_without_their_own(spark, rows):
    prose = [(i, t) for i, t, *_ in rows if i < 90]
    own = [(i, t, "en") for i, t in prose[:60]] + [(100 + i, t, f"y{i}") for i, t in prose[60:68]]  # y0 to y7 have a trusted row each
    junk = " ".join(f"q{k}zx{k * k}" for k in range(80))
    bad = [(200 + k, junk, lang) for k, lang in enumerate([None, "xx", "en", *(f"y{i}" for i in range(60, 68))])]
    docs = spark.createDataFrame([*own, *bad], "doc_id long, text string, lang string")
    labels = lambda ids: spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier(docs, labels(i for i, *_ in own)).collect()}
    assert all(r["perplexity_limit"] is not None for r in got.values())
    assert not any(got[i]["kept"] for i, *_ in bad) and sum(got[i]["kept"] for i, *_ in own) >= 60
    assert len({got[200 + k]["perplexity_limit"] for k in (0, 1)}) == 1
    alone = {r["doc_id"]: r for r in quality_classifier(docs, labels([0])).collect()}  # one trusted row is all there is
    assert all(r["perplexity_limit"] is not None for r in alone.values()) and alone[0]["kept"]


def test_limit_of_all_that_was_not_trained(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t, *_ in rows if i < 120], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality_classifier(docs, labels, rows=10, share=0.5)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    got = got.withColumn("train", (h < 2 * 10 / 120) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0)).collect()
    held = sorted(math.ceil(math.log(r["perplexity"]) / BIN) for r in got if not r["train"])
    limit = math.exp(held[math.ceil(0.5 * len(held)) - 1] * BIN)
    assert len(held) > 100 and all(r["perplexity_limit"] == pytest.approx(limit) for r in got)


def test_bigrams_seen_once(spark):
    model = kneser_ney(spark.createDataFrame([("en", "a b a b a c d")], "lang string, text string")).where("lang = 'en'").collect()
    low = {r["w"]: r["p"] for r in model if r["kind"] == 1}
    weight = {r["v"]: r["p"] for r in model if r["kind"] == 0}
    high = collections.defaultdict(dict)
    for r in model:
        if r["kind"] == 2:
            high[r["v"]][r["w"]] = r["p"]
    (unknown,) = [p for v, p in weight.items() if v is None]
    assert sum(len(x) for x in high.values()) == 6  # ^a ab ba ac cd d$
    assert sum(low.values()) + unknown == pytest.approx(1)
    for v, seen in high.items():
        assert sum(seen.values()) + weight[v] * (1 - sum(low[w] for w in seen)) == pytest.approx(1)


def test_statistics(docs, rows, empty):
    got = {r["doc_id"]: r for r in QR.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall(SPACED, t or "")
        three = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACED, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert sum(got[i]["kept"] for i in range(120)) >= 112
    assert QR.quality_rules(empty).count() == 0


def test_outliers(spark):
    rng = random.Random(8)
    good = [(i, " ".join("x" * rng.randint(3, 8) + str(rng.randrange(10**6)) for _ in range(100)), "en", "a") for i in range(200)]
    bad = [(1000 + i, " ".join("#$%&" + str(rng.randrange(10**6)) for _ in range(100)), "en", "a") for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in QR.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(30))


def test_chi_square():
    assert QR.chi2_quantile(0.75, 4) == pytest.approx(5.385269, abs=1e-5)
    assert QR.chi2_cdf(QR.chi2_quantile(0.999, 4), 4) == pytest.approx(0.999)


# 8 top-k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(700)]
    vectors += [(700 + i, list(vectors[5][1])) for i in range(40)]  # ties
    vectors += [(800, None), (900, [1.0, None] + [0.0] * 6), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (1000, [0.0] * 8), (903, []), (904, [0.5] * 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    whole = {i: np.floor(np.array(v, dtype=np.float32).astype(float) * 1024).astype(np.int64) for i, v in vectors if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        scored = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# 9 language


def test_language(docs, rows, empty):
    held = F.pmod(training_hash(F.col("doc_id")), F.lit(4)) == 2
    model = fit(docs.where(~held))
    got = {r["doc_id"]: r for r in predict(docs, model).collect()}
    assert len(got) == len(rows)
    outside = [r for r in rows if r[0] < 150 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in outside) >= 0.95 * len(outside)
    for i in (200, 201, 202, 205):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert predict(empty, model).count() == 0 and {r["lang_pred"] for r in predict(docs, fit(empty)).collect()} == {"und"}


def test_viterbi():
    rng = np.random.default_rng(7)
    for _ in range(60):
        scores, penalty = rng.normal(0, 2, (6, 3)), rng.uniform(0, 4)
        value = lambda path: sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(3), repeat=6)))
        assert value(viterbi(scores, penalty).tolist()) == pytest.approx(best)


def test_viterbi_of_two_languages_without_the_third():
    assert viterbi(np.array([[0.0, 5, -6], [0, -6, 5]]), 6.0).tolist() == [1, 2]


def test_digests(spark):
    from foldlattice.llm.registry import queries

    r = queries()["op10_forced_boundary_bpe"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_top_k_takes_every_row_of_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [0.25, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, k=2).orderBy("rank").collect()] == [(0, 1, 1, 1048576), (0, 2, 1, 524288)]


def test_rules_group_by_null_and_empty_apart(spark):
    """Null and empty languages are groups of their own: each alone reaches the least size or doesn't."""
    rng = random.Random(1)
    text = lambda k: " ".join("w" * k + str(rng.randrange(10**9)) for _ in range(60))
    rows = [(i, text(2), None, "s") for i in range(60)] + [(100 + i, text(20), "", "s") for i in range(60)]
    got = QR.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), tail=1e-6).collect()
    assert all(r["kept"] for r in got) and max(r["d2"] for r in got) < 20


def test_rules_step_until_still(spark):
    """One more step moves no figure by a hundredth of its floor."""
    rng = np.random.default_rng(3)
    rows = [(1, *map(float, r)) for r in rng.gamma(2.0, 0.1, (4000, 4))] + [(1, 3.0, 3.0, 3.0, 3.0)] * 400
    df = spark.createDataFrame(rows, "grp long, " + ", ".join(f"{f} double" for f in QR.FEATURES))
    once, more = (QR.robust_fit(df, 0.75, steps, still).first() for steps, still in ((25, 0.01), (26, 0.0)))
    for i in range(4):
        assert abs(once[f"c{i}"] - more[f"c{i}"]) <= 0.02 * QR.FLOORS[i]


def test_rows_without_or_with_equal_ids(spark, docs, ids_of):
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    held = F.coalesce(F.col("doc_id"), F.lit(0)) > 1
    counts = {
        "near": near_duplicates(twice).count(), "pack": pack(twice, VOCABULARY).where("piece = 0").count(), "encode": round_trip(twice, VOCABULARY).count(), "score": score_documents(twice, held).count(),
        "licence": scan_licenses(twice).count(), "rules": QR.quality_rules(twice).count(), "language": predict(twice, fit(docs.where("doc_id < 50"))).count(),
    }
    assert counts == {"near": 6, "pack": 7, "encode": 7, "score": 7, "licence": 7, "rules": 7, "language": 7}
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality_classifier(twice.drop("kept"), labels).count() == 7
    path = new_shard_folder(twice)
    write_shards(twice, VOCABULARY, path)
    assert read_documents(spark.read.parquet(path)).count() == 6
    vectors = spark.createDataFrame([(0, [0.5, 0.1]), (0, [0.5, 0.1]), (1, [0.2, 0.9]), (None, [1.0, 1.0]), (2, None)], "vec_id long, embedding array<float>")
    # both rows of id 0 ask, and each is a candidate of the other
    found = [(0, 1, 0, 512 * 512 + 102 * 102), (0, 2, 1, 204 * 512 + 921 * 102)]
    assert sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 100 == 0).collect()) == sorted(found * 2)


# very long texts and ties


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 300,000 words and 2 MB, a near copy of it, one of a single word of 1 MB, and short ones beside them."""
    rng = random.Random(21)
    own = [f"{rng.choice(['ba', 'ko', 'tu', 'xel'])}{rng.randrange(10**5)}" for _ in range(300_000)]
    near = list(own)
    near[1000] = near[200_000] = "other"
    texts = [" ".join(own) + " Released under the MIT License.", " ".join(near), "z" * 1_000_000, "short text here " * 20, None]
    return texts, spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)


def test_long_texts_near_duplicates(long_docs):
    texts, df = long_docs
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i]["n_shingles"] == (len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0)
    assert [got[i]["component_id"] for i in range(5)] == [0, 0, 2, 3, 4]


def test_long_texts_encoded(spark, long_docs, library):
    texts, df = long_docs
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for t in texts]
    path = new_shard_folder(df)
    write_shards(df, VOCABULARY, path, end_id=0, tokens=100_000)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in read_documents(spark.read.parquet(path), with_ids=False).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    trips = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in round_trip(df, VOCABULARY).collect()}
    assert trips == {i: (x[:-1].tobytes(), texts[i] or "") for i, x in enumerate(ids)}
    pieces = {}
    for r in pack(df, VOCABULARY).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, x in enumerate(ids):
        own = sorted(pieces[i])
        assert sum(n for _, n, _ in own) == len(x) and all(n == 2048 for _, n, _ in own[1:])
        assert all(zlib.crc32(x[b : b + n].tobytes()) == crc for b, n, crc in own)


def test_long_texts_scored(spark, long_docs):
    texts, df = long_docs
    got = {r["doc_id"]: r for r in score_documents(df, F.col("doc_id") != 1).collect()}
    assert all(got[i]["n_tokens"] == len(words(t)) + 1 and got[i]["score"] < 0 for i, t in enumerate(texts))
    assert got[1]["score"] > got[1]["base_score"]  # nearly all of it was learned
    found = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    assert (found[0]["n_words"], found[0]["n_base"], found[0]["first_word"], found[0]["base_labels"]) == (300_005, 1, 300_003, "mit")
    assert all(found[i]["n_base"] == 0 for i in range(1, 5))
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier(df, labels).collect()}
    assert kept[0] and kept[3] and not kept[4]


def test_long_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (6, 4000))
    df = spark.createDataFrame([(100 * i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(x * 1024).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 100 == 0, k=2).collect()}
    for q in range(6):
        want = sorted((-int(whole[q] @ whole[i]), 100 * i) for i in range(6) if i != q)[:2]
        assert [got[100 * q, k + 1] for k in range(2)] == [(i, -s) for s, i in want]


def test_ties(spark):
    """Equal lengths fill sequences without loss; a text at the limit is kept; equal rarities find the same links twice."""
    same = spark.createDataFrame([(i, "one two three four five six seven") for i in range(500)], "doc_id long, text string")
    packed = pack(same, VOCABULARY, capacity=20).collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    per = collections.Counter(s for s, *_ in places)
    n = packed[0]["length"]
    assert len(packed) == 500 and len(per) == -(-500 // (20 // n)) and all(o % n == 0 for _, o, _ in places)
    text = "aa bb cc dd ee ff gg"
    alike = spark.createDataFrame([(i, text, "en") for i in range(12)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    judged = quality_classifier(alike, labels).collect()
    assert all(r["kept"] for r in judged) and len({r["perplexity"] for r in judged}) == 1
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]  # every shingle occurs in all texts that hold it equally often
    near = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (3, 40, 80, 110)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string")
    first, second = ([(r["doc_id"], r["component_id"]) for r in near_duplicates(d).orderBy("doc_id").collect()] for d in (df.repartition(1), df.repartition(4)))
    assert first == second == [(0, 0), (1, 0), (2, 0), (3, 0)]
