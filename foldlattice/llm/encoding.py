"""Byte-level BPE encoding in tasks: forced cuts, remembered fragments, and an own merge loop.

A byte pair that no vocabulary token contains can never be merged over, so a text may be cut
between two such bytes and the fragments encoded on their own.  In byte-level vocabularies every
pair (non-space, space) is of this kind, and the pre-tokenizer's pattern cuts there too, so the
text is first cut in front of each space that follows a non-space; the pieces repeat, and each
worker remembers their ids.  Within a piece, pre-tokens are cut at all further forced pairs.

Texts are encoded whole.  Null encodes as the empty text.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow
from foldlattice.llm.textblocks import slices

_NONE = 1 << 30
#: A word of Latin letters with at most one mark behind it: its pre-tokens are plain.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?])?")
_CUT = re.compile(r"(?<=\S) ")
_GLUED = re.compile(r"\s ")
#: The byte-level pre-tokenizer's published pattern (fixed value).
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces in each of a worker's two memories (some 200 bytes a piece), and the longest piece that is remembered.
REMEMBERED = 800_000
LONGEST = 80
#: Marks that are one pre-token behind a word, however many (ASCII, no apostrophe).
MARKS = "!#$%&*,.:;<>?|"
#: Fragments over so many bytes are merged with a heap, the others all at once.
LONG_FRAGMENT = 256


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def pretokens(piece: str) -> list[str]:
    """Pre-tokens of a piece."""
    m = _WORD.fullmatch(piece, 1 if piece[:1] == " " else 0)
    if m is None:
        return PRETOKEN.findall(piece)
    return [piece] if m[2] is None else [piece[:-1], piece[-1]]


class ForcedCutBpe:
    """Byte-level BPE from a vocabulary file of merges, by forced cuts and then merging by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if spec["pre_tokenizer"] else []
        if spec["normalizer"] or spec["model"].get("dropout") or [(s["type"], s.get("add_prefix_space"), s.get("use_regex", True)) for s in steps] != [("ByteLevel", False, True)]:
            raise ValueError(f"{path}: only byte-level vocabularies with the standard pattern and no normalizer are read")
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        inside = np.zeros(65536, dtype=bool)
        for token in self.token_bytes:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[b[:-1] * 256 + b[1:]] = True
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.forced = ~inside
        spaces = np.array([0x20, *range(0x09, 0x0E), 0x85, 0xA0])
        self.space_is_forced = not inside[np.setdiff1d(np.arange(256), spaces) * 256 + 0x20].any()
        self.single = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.single[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.by_key = np.argsort(keys, kind="stable")
        self.keys, self.new = keys[self.by_key], np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of id pairs, or _NONE."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], _NONE)

    def encode_many(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces without special tokens, all of them merged in step."""
        raw, starts, ends, at = [], [], [], 0
        for piece in pieces:
            for token in pretokens(piece):
                starts.append(at)
                raw.append(b := token.encode("utf-8", "surrogatepass"))
                at += len(b)
            ends.append(at)
        if not at:
            return [b""] * len(pieces)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        cut = np.zeros(at, dtype=bool)
        cut[starts] = True
        cut[1:] |= self.forced[data[:-1] * 256 + data[1:]]
        ids, kept = self._merge_all(data, np.cumsum(cut) - 1)
        bounds = np.searchsorted(kept, np.array([0, *ends]))
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * b : 4 * e] for b, e in zip(bounds, bounds[1:])]

    def _merge_all(self, data: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids of all fragments in order, and the byte place of each.

        In each round every fragment merges its lowest-ranked pair, from left to right.
        """
        ids, place = self.single[data], np.arange(len(data))
        rank = np.full(len(data), _NONE, dtype=np.int64)
        rank[:-1] = np.where(fragment[1:] == fragment[:-1], self.of_bytes[data[:-1] * 256 + data[1:]], _NONE)
        long = np.bincount(fragment)[fragment] > LONG_FRAGMENT
        done = []
        if long.any():
            for f in np.unique(fragment[long]):
                own = np.flatnonzero(fragment == f)
                merged, where = self._merge_long(ids[own].tolist())
                done.append((np.array(merged), own[where]))
            ids, place, rank, fragment = ids[~long], place[~long], rank[~long], fragment[~long]
        while len(ids):
            first = np.concatenate(([0], np.flatnonzero(fragment[1:] != fragment[:-1]) + 1))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            live = low < _NONE
            done.append((ids[~live], place[~live]))
            ids, place, rank, fragment, low = ids[live], place[live], rank[live], fragment[live], low[live]
            if not len(ids):
                break
            hit = rank == low
            at = np.flatnonzero(hit)
            if len(at) > 1 and (touching := np.diff(at) == 1).any():  # of equal tokens in a row, every second pair
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            ids[at] = self.new[low[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            rank[at] = rank[at + 1]
            last = rank[at] == _NONE
            ids, place, rank, fragment = ids[keep], place[keep], rank[keep], fragment[keep]
            again = np.unique(np.concatenate((moved[at], moved[at] - 1)))
            again = again[(again >= 0) & (again < len(ids) - 1)]
            rank[moved[at[last]]] = _NONE
            rank[again] = np.where(fragment[again] == fragment[again + 1], self.rank(ids[again], ids[again + 1]), _NONE)
        ids, place = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(place, kind="stable")
        return ids[order], place[order]

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Ids and places of one fragment of any length, by a heap and links."""
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        ranks = self.rank(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
            if known[pair] < _NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.new[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        where = [i for i, x in enumerate(ids) if x >= 0]
        return [ids[i] for i in where], where

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class PieceEncoder:
    """Whole texts to packed little-endian 32-bit ids, piece by piece.

    ``encode_many`` gives the packed ids of pieces that aren't remembered.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], special: dict[str, int], cut_at_spaces: bool, top_id: int):
        self.encode_many, self.special, self.cut_at_spaces, self.top_id = encode_many, special, cut_at_spaces, top_id
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.any_special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text without special tokens; all but the first stand for a space and themselves.

        The first is marked by a leading NUL, so that both kinds are remembered in one place.
        """
        if not self.cut_at_spaces or "\0" in text:
            return ["\0" + text]
        pieces = _CUT.split(text) if _GLUED.search(text) or text[0] == " " else text.split(" ")
        pieces[0] = "\0" + pieces[0]
        return pieces

    def _parts(self, text: str | None) -> list[str | int]:
        """Texts between special tokens, and those tokens' ids."""
        if not text:
            return []
        if self.any_special is None or not self.any_special.search(text):
            return [text]
        out, at = [], 0
        for m in self.any_special.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [x for x in [*out, text[at:]] if x != ""]

    def _plans(self, texts: list[str | None]) -> list[list[list[str] | bytes]]:
        return [[array("I", [x]).tobytes() if isinstance(x, int) else self._pieces(x) for x in self._parts(t)] for t in texts]

    def packed_many(self, texts: list[str | None]) -> list[bytes]:
        plans = self._plans(texts)
        missing = set().union(*(x for plan in plans for x in plan if isinstance(x, list)))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        missing.difference_update(self.known)
        again = missing.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        missing = list(missing.difference(again))
        once = {}
        if missing:
            got = self.encode_many([p[1:] if p[:1] == "\0" else " " + p for p in missing])
            self.known.update((p, g) for p, g in zip(missing, got) if len(p) <= LONGEST)
            once = {p: g for p, g in zip(missing, got) if len(p) > LONGEST}
        known = self.known.__getitem__
        look = known if not once else lambda p: once[p] if p in once else known(p)
        return [b"".join(b"".join(map(look, x)) if isinstance(x, list) else x for x in plan) for plan in plans]


class _LibraryPieces(dict):
    """Packed ids of pieces by the library's model; a missing piece is encoded and remembered.

    A full memory becomes the older one, which is asked before a piece is encoded again.  A word with
    marks behind it is the word's ids and the marks', a line's first piece the line end's and the rest's.
    """

    def __init__(self, library, letter: dict[int, str], remembered: int, size: int):
        super().__init__()
        self.remembered = remembered
        self.model, self.letter, self.older = library.model, [letter[b] for b in range(256)], {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.space, self.line_end = letter[0x20], self._packed(letter[0x0A])

    def _packed(self, token: str) -> bytes:
        """Ids of one pre-token, given as its bytes' letters."""
        own = self.id_bytes
        return b"".join([own[t.id] for t in self.model.tokenize(token)])

    def _lettered(self, text: str) -> str:
        return "".join(map(self.letter.__getitem__, text.encode("utf-8", "surrogatepass")))

    def _encoded(self, piece: str) -> bytes:
        before, bare = b"", piece[1:] if piece[:1] == "\0" else " " + piece
        if bare[:1] == "\n" and bare[1:2].isalpha():  # this line end stands alone
            before, bare = self.line_end, bare[1:]
        word = bare.rstrip(MARKS)
        if not word[word[:1] == " " :].isalpha():  # letters alone make one pre-token with the space before them, and marks behind them one more
            return before + b"".join(self._packed(self._lettered(token)) for token in pretokens(bare))
        if len(word) < len(bare):
            return self[piece[: len(word) - len(bare)]] + self._packed(bare[len(word) :])
        return before + self._packed(word.replace(" ", self.space) if word.isascii() else self._lettered(word))

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self._encoded(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class LibraryEncoder(PieceEncoder):
    """The same pieces, encoded one at a time by the tokenizers library."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        bpe = ForcedCutBpe(path)
        super().__init__(None, bpe.special, bpe.space_is_forced, bpe.size - 1)
        self.known = _LibraryPieces(Tokenizer.from_file(path), {b: c for c, b in byte_letters().items()}, remembered, bpe.size)

    def _pieces(self, text: str) -> list[str]:
        """Also cut in front of line ends where none has a space or another beside it, so that words at them repeat as others do."""
        if "\n" in text and self.cut_at_spaces and "\0" not in text:
            lines = text.split("\n")
            if not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
                text = " \0\n".join(lines)
                pieces = _CUT.split(text) if _GLUED.search(text) else text.split(" ")
                pieces[0] = "\0" + pieces[0]
                return pieces
        return super()._pieces(text)

    def packed_many(self, texts: list[str | None]) -> list[bytes]:
        look = self.known.__getitem__
        return [b"".join(b"".join(map(look, x)) if isinstance(x, list) else x for x in plan) for plan in self._plans(texts)]


@lru_cache(maxsize=4)
def forced_cut_encoder(path: str) -> tuple[ForcedCutBpe, PieceEncoder]:
    """The own encoder of a worker, kept between tasks."""
    bpe = ForcedCutBpe(path)
    return bpe, PieceEncoder(bpe.encode_many, bpe.special, bpe.space_is_forced, bpe.size - 1)


@lru_cache(maxsize=4)
def library_encoder(path: str, remembered: int = REMEMBERED) -> LibraryEncoder:
    """The tokenizers library's encoder of a worker, kept between tasks."""
    return LibraryEncoder(path, remembered)


def texts_in(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of an Arrow batch (id, text) in runs of bounded size."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for part in slices([len(t or "") for t in texts], most):
        yield ids[part], texts[part]


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: forced-boundary encoding of each whole text and its decoding; null is empty, and ids are passed on as they are.

    A text of any length is encoded in one piece of work, so a task holds its ids; repeated rows are encoded each
    on their own, null ids stay null, and an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = forced_cut_encoder(vocabulary)
        for batch in batches:
            for ids, texts in texts_in(batch, 4_000_000):
                packed = encoder.packed_many(texts)
                decoded = [bpe.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(in_arrow, work, "doc_id long, ids binary, decoded string")
