"""Words and word sequences of whole Arrow batches as 64-bit hashes, with numpy and without a loop over words.

A word is hashed in blocks of eight bytes, each mixed into what the blocks before gave; a sequence is hashed as a tree
whose nodes mix two halves. Neither is a polynomial, so words and sequences of regular make-up collide no more than any
others. Words of up to eight bytes and equal length never do. Equal sequences always have equal hashes. Where an
operator must tell different ones apart it compares the words, or a second hash that shares nothing with the first but
the words (another ``seed``, for words and sequences).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from ..functions.batches import slices  # noqa: F401

#: Bytes of words: all but 0x20 and 0x09-0x0D, as in the pattern [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_u = np.uint64
_ODD = _u(0x9E3779B97F4A7C15)
#: Bytes hashed at a time: small enough for a core's cache.
CHUNK = 1 << 16
#: Longer words are hashed by SHA-256.
LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _u(31))
    h *= _u(0xBF58476D1CE4E5B9)
    h ^= h >> _u(29)
    h *= _u(0x94D049BB133111EB)
    h ^= h >> _u(32)
    return h


@dataclass
class Words:
    """The words of the documents of one slice, in order."""

    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    doc: np.ndarray  # index of each word's document
    first: np.ndarray  # index of each document's first word; one entry more than documents

    def hashes(self, seed: int = 0, of: np.ndarray | None = None) -> np.ndarray:
        """The hash of each word, or of those at the indexes ``of``."""
        start, end = (self.start, self.end) if of is None else (self.start[of], self.end[of])
        out = np.empty(len(start), np.uint64)
        step = CHUNK // 4
        for at in range(0, len(start), step):
            out[at : at + step] = self._hashes(start[at : at + step], end[at : at + step], seed)
        return out

    def _hashes(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        size = end - start
        out = mix((size.astype(np.uint64) + _u(seed << 32)) * _ODD)
        low = int(start[0])
        near = np.concatenate([self.data[low : int(end[-1])], np.zeros(8, np.uint8)])
        blocks = np.ndarray(len(near) - 7, "<u8", near, 0, (1,))  # eight bytes from each one on
        left, at, which = size, start - low, slice(None)
        if (size > LONG).any():
            for i in np.flatnonzero(size > LONG).tolist():
                digest = hashlib.sha256(seed.to_bytes(4, "little") + near[start[i] - low : end[i] - low].tobytes()).digest()
                out[i] = int.from_bytes(digest[:8], "little")
            which = np.flatnonzero(size <= LONG)
            left, at = left[which], at[which]
        while len(at):
            out[which] = mix(out[which] ^ blocks[at] & _FIRST[np.minimum(left, 8)])
            more = np.flatnonzero(left > 8)
            which = more if isinstance(which, slice) else which[more]
            left, at = left[more] - 8, at[more] + 8
        return out


#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """``inside``: 256 booleans, the bytes of words."""
    is_in = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = is_in[:-1], is_in[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(is_in & ~before), np.flatnonzero(is_in & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def window_hashes(h: np.ndarray, doc: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words from one document, of the words' hashes ``h``; with the index of its first
    word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = _ODD + _u(4 * seed)
    part, length, total, done = h, 1, None, 0
    while True:
        if size & length:
            # the tree's parts lie from the last word to the first, small ones behind
            done += length
            own = part[size - done : size - done + n]
            total = own if total is None else mix(own * factor + total)
        if length * 2 > size:
            break
        part = mix(part[: len(part) - length] * factor + part[length:])
        length *= 2
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[at] + _u(size)), at
