import random

import pytest

LANGS = {"en": "the of and thing ation er ing ou le st re an".split(), "de": "der die und ung keit sch ein ü ä pf tz".split(), "fr": "le la les eau tion é è ç que ment".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    syllables = LANGS[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): prose, copies, near copies, nulls, blanks, odd and long texts."""
    rng = random.Random(11)
    out = []
    for i in range(120):
        lang = rng.choice(list(LANGS))
        out.append((i, prose(rng, lang, rng.randint(60, 200)), lang, f"s{i % 3 and 1}"))
    for i in range(120, 150):  # copies and near copies of a few
        base = out[i % 4][1].split()
        if i % 3:
            base[rng.randrange(len(base))] = f"changed{i}"
        out.append((i, " ".join(base), out[i % 4][2], "s0"))
    odd = [None, "", "  \n\t ", "one", "a b c", "!!! *** ###", "x<|endoftext|>y <|endoftext|>", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "日本語 テスト", "same line\nsame line\nsame line", "ab" * 4000, " ".join(["la la la"] * 60), "\0 nul \0"]
    out += [(200 + i, t, None if i % 2 else "en", None if i % 3 else "s1") for i, t in enumerate(odd)]
    out.append((300, prose(rng, "en", 6000), "en", "s1"))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_words string, batch string, kept string, length string, rank string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
