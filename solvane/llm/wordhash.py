"""Vectorised words of many texts at once: byte classes, runs, and a 64-bit hash of each run.

Defined results: null and empty texts have no tokens; a run of any length is one
token, hashed whole; equal runs have equal hashes wherever they stand, and
different ones share a hash with a chance of about one in 2**63.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a run that have a factor each; runs that are longer are hashed in blocks of so many bytes.
_BLOCK = 4096


def finish(h: np.ndarray) -> np.ndarray:
    """Spreads a sum of products over all 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _factors(numbers: np.ndarray) -> np.ndarray:
    """Odd 64-bit factors that have nothing to do with each other, by number."""
    with np.errstate(over="ignore"):
        return finish((numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


FACTORS = _factors(np.arange(_BLOCK))
#: A-Z become a-z, other bytes stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Classes of bytes: 0 parts words, 1 is in words, 2 is punctuation; runs of one class are tokens.
SPACES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], np.uint8)
WORDS_AND_SIGNS = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


@dataclass
class Tokens:
    """Tokens of several texts, one text after another."""

    raw: np.ndarray  #: the texts' bytes as they are
    low: np.ndarray  #: A-Z lower-cased
    start: np.ndarray  #: first byte of each token
    size: np.ndarray  #: its bytes
    kind: np.ndarray  #: its class
    hash: np.ndarray  #: of its lower-cased bytes
    first: np.ndarray  #: first token of each text, and the number of tokens at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each token belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def tokens(texts: list[str | None], classes: np.ndarray = SPACES) -> Tokens:
    """Maximal runs of bytes of one class, class 0 left out; None has no tokens."""
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    begins = np.cumsum(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
    cls = classes[raw]
    if len(raw) == 0:
        none = np.zeros(0, np.int64)
        return Tokens(raw, raw, none, none, cls, none.astype(np.uint64), np.zeros(len(texts) + 1, np.int64))
    edge = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    length = np.diff(np.r_[edge, len(raw)])
    own = cls[edge] > 0
    start, size = edge[own], length[own]
    low = LOWER[raw]
    if len(start):
        place = np.arange(len(raw)) - np.repeat(edge, length)
        with np.errstate(over="ignore"):
            value = (low.astype(np.uint64) + np.uint64(1)) * FACTORS[place % _BLOCK]
            far = np.flatnonzero(place >= _BLOCK)
            if len(far):
                value[far] *= _factors(place[far] // _BLOCK + _BLOCK)
            value[cls == 0] = 0
            hashed = finish(np.add.reduceat(value, start) + size.astype(np.uint64))
    else:
        hashed = np.zeros(0, np.uint64)
    return Tokens(raw, low, start, size, cls[start], hashed, np.r_[0, np.searchsorted(start, begins)])


def prefix_hash(t: Tokens, n: int) -> np.ndarray:
    """Hash of each token's first n lower-cased bytes; of shorter tokens 0."""
    out = np.zeros(len(t.start), np.uint64)
    ok = np.flatnonzero(t.size >= n)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[ok] += (t.low[t.start[ok] + k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
        out[ok] = finish(out[ok] + np.uint64(0xA5A5A5A5A5A5A5A5) + np.uint64(n))
    return out
