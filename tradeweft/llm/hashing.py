"""64-bit hashes of all words of many texts at once, with numpy, and their exact comparison.

A word is a run of bytes other than the breaks. It is read eight bytes at a time; each step mixes
the bytes into the hash of what came before, so no structure of the word makes two words agree. Long
words are hashed one by one. Equal hashes are only a hint: :func:`distinct` compares the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the lowest 0 to 8 bytes of eight.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text has a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``raw`` needs eight more bytes than are used."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def hashes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words ``raw[start:end]``; ``raw`` goes on for eight bytes behind the last."""
    eights, sizes = _eights(raw), ends - starts
    out = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    open_, at = np.flatnonzero(sizes <= _LONG), 0
    while len(open_):
        left = np.minimum(sizes[open_] - at, 8)
        out[open_] = mix(out[open_] ^ (eights[starts[open_] + at] & _KEEP[left]))
        at += 8
        open_ = open_[sizes[open_] > at]
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the same bytes as the word whose number is in ``other``."""
    eights, sizes = _eights(raw), ends - starts
    same = sizes == sizes[other]
    open_, at = np.flatnonzero(same & (other != np.arange(len(other)))), 0
    while len(open_):
        left = np.minimum(sizes[open_] - at, 8)
        good = (eights[starts[open_] + at] ^ eights[starts[other[open_]] + at]) & _KEEP[left] == 0
        same[open_[~good]] = False
        at += 8
        open_ = open_[good & (sizes[open_] > at)]
    return same


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first word of each kind, and the kind of every word. Words of one hash but
    with other bytes are kinds of their own."""
    order = hashes.argsort()  # not stable, so faster than that of np.unique
    ranked, new, kind = hashes[order], np.ones(len(order), bool), np.empty(len(order), np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    kind[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    odd = np.flatnonzero(~equal_words(raw, starts, ends, first[kind]))
    if len(odd):
        more: dict[tuple[int, bytes], int] = {}
        for i in odd.tolist():
            key = int(hashes[i]), raw[starts[i]:ends[i]].tobytes()
            kind[i] = len(first) + more.setdefault(key, len(more))
        at = np.full(len(more), len(hashes), np.int64)
        np.minimum.at(at, kind[odd] - len(first), odd)
        first = np.concatenate([first, at])
    return first, kind


def cut_words(texts: list[bytes], breaks: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    """Folded bytes of all texts, start, end and hash of each word, and the bounds of each text's words.

    ``breaks`` marks the bytes between words, among them the space; ``fold`` maps bytes first.
    """
    raw = fold[np.frombuffer(b" ".join([b"", *texts, b" " * 8]), np.uint8)]
    gap = breaks[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    return raw, starts, ends, hashes_of(raw, starts, ends), np.searchsorted(starts, begin)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and the bounds of each text."""
    return cut_words(texts, _SPACE, _LOWER)[3:]
