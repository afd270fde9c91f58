"""Vectorised word and shingle hashing shared by the document operators.

All helpers work on one Arrow batch at a time inside a task.  A batch's texts are laid end to
end in one byte array, so that hashing costs a few numpy passes a batch instead of a Python
step a word.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(n: int) -> np.ndarray:
    """1, m, m^2 ... of an odd multiplier modulo 2^64."""
    out = np.full(max(n, 1), 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes and places of all words of a list of texts (None counts as empty).

    ``hashes`` holds one 64-bit hash a word in order, ``bounds[i]:bounds[i + 1]`` the words of
    text i, ``starts`` and ``ends`` byte places in ``data`` (the lower-cased bytes).
    """

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        space = _IS_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.bounds = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        self.hashes = np.zeros(len(self.starts), dtype=np.uint64)
        if len(self.starts):
            keep = ~space
            places = np.cumsum(keep) - 1
            first = places[self.starts]
            within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            table = powers(int(lengths.max()) + 1)
            self.hashes = mix(np.add.reduceat(_BYTE[data[keep]] * table[within], first) + lengths.astype(np.uint64) * _ODD)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each window of ``size`` words; order matters."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for j, m in enumerate(powers(size + 1)[1:]):
            out += hashes[j : j + n] * m
        out = mix(out)
    return out


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, none is empty."""
    words = Words(texts)
    for i in range(len(texts)):
        own = words.of(i)
        yield np.unique(windows(own, size if len(own) >= size else len(own))) if len(own) else own


def slices(n_chars: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Runs of rows of about ``most`` characters, at least one row each, so that memory stays bounded."""
    begin = total = 0
    for i, n in enumerate(n_chars):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(n_chars):
        yield slice(begin, len(n_chars))
