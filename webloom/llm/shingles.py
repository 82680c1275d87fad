"""Hashes of word shingles, for many texts at once in numpy.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash takes its bytes
eight at a time; a shingle's hash takes its words in order. All hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

_K1, _K2, _K3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    h = h * _K1
    h ^= h >> np.uint64(29)
    h *= _K2
    h ^= h >> np.uint64(32)
    return h


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a lower-cased buffer."""
    data = np.frombuffer(joined, np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = ends - starts
    h = length.astype(np.uint64) * _K3
    if len(starts):
        padded = np.frombuffer(joined + bytes(8), np.uint8)
        eights = np.ndarray((len(joined) + 1,), "<u8", padded, strides=(1,))
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            left = ends[live] - at
            piece = eights[at] & _LOW[np.minimum(left, 8)]
            h[live] = mix(h[live] ^ piece)
            go = (left > 8) & (length[live] <= _LONG)
            live, at = live[go], at[go] + 8
        for i in np.flatnonzero(length > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(joined[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, starts


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text and with repeats, and the number of each text.

    A text of fewer than ``size`` words has one shingle, the whole sequence; one without words has none.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, starts = word_hashes(b"\n".join(t.lower() for t in texts))
    of = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(of, minlength=len(texts))
    n = len(words) - size + 1
    if n > 0:
        h = mix(words[:n] ^ np.uint64(size))
        for k in range(1, size):
            h = mix(h * _K3 ^ words[k : k + n])
        whole = of[:n] == of[size - 1 :]
        h, owner = h[whole], of[:n][whole]
    else:
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = []
        for i in short.tolist():
            x = mix(np.array([counts[i]], np.uint64))
            for w in words[begin[i] : begin[i] + counts[i]]:
                x = mix(x * _K3 ^ w)
            extra.append(x[0])
        h, owner = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order."""
    h, counts = shingle_hashes(texts, size)
    out, at = [], 0
    for n in counts.tolist():
        own = np.sort(h[at : at + n])
        at += n
        if n > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
    return out
