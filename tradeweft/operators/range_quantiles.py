"""Order statistics of ranges of time and size, for all ranges of a group at once.

Trades lie in the order of time, and their values are halved bit by bit (a wavelet matrix over the ranks of
the values). A range walks down with the part of the sequence that is its own: where the lower half holds
enough of its trades it goes there, else it passes them by. How many that are is a count over part of a
sequence and a span of sizes, and comes from a second matrix over the ranks of the sizes. So trades and ranges
take O(log^2 n) steps each, all of them numpy steps over whole arrays; no range meets its trades one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _zeros_before(bit: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(bit == 0)))


def _parted(bit: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.concatenate((rows[bit == 0], rows[bit == 1]))


def _count_below(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of ``ranks[lo:hi]`` are below ``limit``, for arrays of ranges."""
    found = np.zeros(len(lo), np.int64)
    for level in reversed(range(len(ranks).bit_length())):
        bit = ranks >> level & 1
        zeros = _zeros_before(bit)
        lo0, hi0 = zeros[lo], zeros[hi]
        upper = limit >> level & 1 == 1
        found += np.where(upper, hi0 - lo0, 0)
        lo, hi = np.where(upper, zeros[-1] + lo - lo0, lo0), np.where(upper, zeros[-1] + hi - hi0, hi0)
        ranks = _parted(bit, ranks)
    return found


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value (ties in order of place) and the values by rank."""
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    return ranks, values[order]


def range_quantiles(time: np.ndarray, size: np.ndarray, value: np.ndarray, times: tuple[np.ndarray, np.ndarray],
                    sizes: tuple[np.ndarray, np.ndarray], levels: Sequence[float]) -> np.ndarray:
    """Interpolated quantiles of the values of trades in each range (bounds inclusive), one row per range.

    ``times`` and ``sizes`` hold the lower and the upper bounds. Ranges without a trade give NaN.
    """
    order = np.argsort(time, kind="stable")
    time, size, value = time[order], size[order], value[order]
    lo, hi = np.searchsorted(time, times[0], "left"), np.searchsorted(time, times[1], "right")
    hi = np.maximum(lo, hi)
    by_size, sorted_size = _ranks(size)
    by_value, sorted_value = _ranks(value)
    small, large = np.searchsorted(sorted_size, sizes[0], "left"), np.searchsorted(sorted_size, sizes[1], "right")
    large = np.maximum(small, large)

    def between(ranks, lo, hi, small, large):
        both = _count_below(ranks, np.tile(lo, 2), np.tile(hi, 2), np.concatenate((large, small)))
        return both[:len(lo)] - both[len(lo):]

    total = between(by_size, lo, hi, small, large)
    at = (total - 1)[:, None] * np.asarray(levels, float)
    below = np.floor(at).astype(np.int64)
    wanted = np.stack((below, np.ceil(at).astype(np.int64)), axis=2).reshape(len(lo), 2 * len(levels))
    each = wanted.shape[1]
    left = np.maximum(wanted, 0).ravel()
    lo, hi, small, large = (np.repeat(x, each) for x in (lo, hi, small, large))
    rank = np.zeros(len(left), np.int64)
    for level in reversed(range(max(len(value) - 1, 0).bit_length())):
        bit = by_value >> level & 1
        zeros = _zeros_before(bit)
        by_value, by_size = _parted(bit, by_value), _parted(bit, by_size)
        lo0, hi0 = zeros[lo], zeros[hi]
        lower = between(by_size, lo0, hi0, small, large)
        up = left >= lower
        left, rank = np.where(up, left - lower, left), rank + np.where(up, 1 << level, 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
    known = np.repeat(total > 0, each)
    picked = np.full(len(rank), np.nan)
    picked[known] = sorted_value[rank[known]]
    picked = picked.reshape(len(total), len(levels), 2)
    share = at - below
    with np.errstate(invalid="ignore"):
        return np.where(share == 0, picked[:, :, 0], picked[:, :, 0] + (picked[:, :, 1] - picked[:, :, 0]) * share)
