"""Licence scan by a positional index of rare template words.

Template words are weighed by their inverse document frequency over all scanned documents.  Each
template is indexed by its rarest words, just so many that it can't reach its share without one of
them in place: a posting (template, place) of such a word and a place in the text name the place
where the template would begin.  All such places are compared word by word, and a template is
reported where enough of its words stand at their relative places and one of its mandatory key
phrases stands within it.  So no template is missed, however many stand in a text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow
from foldlattice.llm.textblocks import slices

#: Key phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, text and mandatory key phrases of each template (fixed values: public licence notices).
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
)
#: The share of a template's words, by weight, that must stand in place.
SHARE = 0.75

#: Words are runs of 0-9, a-z, A-Z and all beyond ASCII; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


PHRASE_WORDS = {tuple(p.encode().split()): label for p, label in PHRASES.items()}
TEMPLATE_WORDS = tuple((label, words_of(text), tuple(words_of(k) for k in keys)) for label, text, keys in TEMPLATES)
VOCABULARY = frozenset(w for _, words, _ in TEMPLATE_WORDS for w in words)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each template word, and all documents: no more rows than template words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                found.update(VOCABULARY.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found] + [""]), pa.array([*found.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).transform(in_arrow, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return {w: got.get(w.decode(), 0) for w in VOCABULARY}, got.get("", 0)


class Index:
    """Postings (template, place) of each template's rarest words, and all words' weights."""

    def __init__(self, frequencies: dict[bytes, int], n_docs: int):
        self.idf = {w: math.log((1 + n_docs) / (1 + n)) + 1 for w, n in frequencies.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.total = [sum(self.idf[w] for w in words) for _, words, _ in TEMPLATE_WORDS]
        for t, (_, words, _) in enumerate(TEMPLATE_WORDS):
            held = 0.0
            for place in sorted(range(len(words)), key=lambda k: (-self.idf[words[k]], words[k])):
                if held > (1 - SHARE) * self.total[t] * (1 + 1e-9):
                    break  # without one of the places so far, less than SHARE is left
                held += self.idf[words[place]]
                self.postings[words[place]].append((t, place))

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``(label, first word, last word, score)`` of each template found in a text."""
        rare = self.postings.keys() & set(words)
        if not rare:
            return []
        begins = {(t, at - place) for at, w in enumerate(words) if w in rare for t, place in self.postings[w]}
        out = []
        for t, begin in sorted(begins):
            label, template, keys = TEMPLATE_WORDS[t]
            part = words[max(begin, 0) : begin + len(template)]
            score = sum(self.idf[w] for k, w in enumerate(template) if 0 <= begin + k < len(words) and words[begin + k] == w) / self.total[t]
            if score >= SHARE and any(_places(part, key) for key in keys):
                out.append((label, max(begin, 0), min(begin + len(template), len(words)) - 1, score))
        return out


def _places(words: list[bytes], phrase: list[bytes] | tuple[bytes, ...]) -> list[int]:
    """Places where a phrase's words stand one after another."""
    out, at, n = [], -1, len(phrase)
    first, rest = phrase[0], list(phrase[1:])
    for _ in range(words.count(first)):
        at = words.index(first, at + 1)
        if words[at + 1 : at + n] == rest:
            out.append(at)
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    ``score`` is the best template match (1 for a key phrase alone is never given: 0.5), 0 without
    a find; ``spans`` are the templates' (label, first, last, score).  A null text is empty; ids are passed on as they are.
    Texts are scanned whole, however long; repeated rows are scanned each on their own; an empty table gives no rows.
    """
    frequencies, n_docs = document_frequencies(docs, text_col)
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequencies, n_docs)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices([len(t or "") for t in texts]):
                rows = []
                for text in texts[part]:
                    words = words_of(text)
                    base = [(at, label) for phrase, label in PHRASE_WORDS.items() for at in _places(words, phrase)]
                    found = index.scan(words)
                    base_labels = {label for _, label in base}
                    score = max([0.5 * bool(base), *(f[3] for f in found)])
                    first, last = (min(base)[0], max(base)[0]) if base else (None, None)
                    rows.append((len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {f[0] for f in found})), min(1.0, score), [dict(zip(("label", "first", "last", "score"), f)) for f in found]))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.transform(in_arrow, work, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,score:double>>")
