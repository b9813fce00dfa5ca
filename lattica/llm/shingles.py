"""Hashes of word shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bases of the polynomials over bytes and over words, odd, so that their powers can be undone modulo 2 ** 64.
_BYTES, _WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes that are hashed at a time: bounds what is held beside a text, however long it is.
SLICE = 1 << 18
_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2 ** 64: n of them, by rows of a square."""
    if not n:
        return np.zeros(0, np.uint64)
    side = max(int(n**0.5), 1)
    low = np.multiply.accumulate(np.r_[np.uint64(1), np.full(side - 1, base, np.uint64)])
    rows = -(-n // side)
    high = np.multiply.accumulate(np.r_[np.uint64(1), np.full(rows - 1, pow(base, side, 1 << 64), np.uint64)])
    return (high[:, None] * low).ravel()[:n]


_UP, _DOWN = powers(_BYTES, SLICE + 1), powers(pow(_BYTES, -1, 1 << 64), SLICE + 1)


def _hashes_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end]: of each the sum of its bytes times powers, from prefix sums by slices."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + SLICE, side="right"))
        if j <= i:  # a word longer than a slice, piece by piece
            total = 0
            for at in range(lo, int(ends[i]), SLICE):
                piece = data[at : min(at + SLICE, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                total += int((piece * _UP[: len(piece)]).sum(dtype=np.uint64)) * pow(_BYTES, at - lo, 1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        part = data[lo : int(ends[j - 1])].astype(np.uint64)
        part += np.uint64(1)
        part *= _UP[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        a = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[a]) * _DOWN[a]
        i = j
    return mix(out)


class Words:
    """The words of texts, lower-cased A-Z and cut at ASCII white space, one text after the other, with hashes of any
    run of words: prefix sums of a polynomial over the words' hashes. Beside the texts it holds about 40 bytes a word."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().lower() for t in texts]
        # A space before each text and after the last keeps words apart.
        data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        begin = np.cumsum([1, *(len(x) + 1 for x in raw)])
        del raw
        edges = np.flatnonzero(np.diff(_SPACE[data].view(np.int8))) + 1
        starts, ends = edges[::2], edges[1::2]
        #: first word of each text
        self.first = np.searchsorted(starts, begin[:-1])
        self.n_words = np.searchsorted(starts, begin[1:]) - self.first
        self._words = _hashes_of_words(data, starts, ends)
        n = len(starts)
        self._down = powers(pow(_WORDS, -1, 1 << 64), n + 1)
        self._sums = np.empty(n + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(self._words * powers(_WORDS, n), out=self._sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs of words from first to last, both included."""
        return mix((self._sums[last + 1] - self._sums[first]) * self._down[first])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number by text) of the shingles of k words in order; a text of fewer words has one of them all."""
        n = np.where(self.n_words >= k, self.n_words - k + 1, np.minimum(self.n_words, 1))
        at = np.repeat(self.first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        end = np.repeat(self.first + self.n_words - 1, n)
        return self.hashes(at, np.minimum(at + k - 1, end)), n

    def words(self) -> np.ndarray:
        """Hashes of all words."""
        return self._words


def chunks(texts: list[str | None], size: int = 3_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters each, at least a text."""
    first = total = 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_chunks(texts: pa.Array, size: int = 3_500_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """(start, end, texts) of ranges of an Arrow column of about `size` bytes each, at least a text: only one range at a time is
    held as Python strings."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size)))
        yield a, b, texts.slice(a, b - a).to_pylist()
        a = b


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, n = Words(texts).shingles(k)
    ends = np.cumsum(n)
    return [np.unique(h[e - z : e]) for e, z in zip(ends, n, strict=True)]
