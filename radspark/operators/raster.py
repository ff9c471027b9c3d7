"""Sums over disks for one dense tile whose places lie on the whole-number lattice: a convolution with the disk, by Fourier transforms.

Work is that of the tile's lattice, whatever the number of places in it, so it doesn't grow with the density.  Values are cut into limbs
of so few bits that rounding the transform's results gives exact sums of whole numbers.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Most lattice points of a tile with its margin.
MOST = 1 << 24
#: Nanoseconds of a transform for each lattice point, and of a strip for each place and for each place and column.
CELL_NS, STRIP_NS, COLUMN_NS = 50, 500, 300
#: Rounding errors of a transform in parts of the norms of both its inputs; errors that limbs are cut for, and those seen from which no result is given.
_ROUNDING, _AIM, _SEEN = 16 * 2.0**-53, 0.1, 0.2


@functools.cache
def _lengths() -> np.ndarray:
    return np.array(sorted(2**a * 3**b * 5**c for a in range(25) for b in range(16) for c in range(11) if 2**a * 3**b * 5**c <= MOST))


def _length(n: int) -> int:
    """The least length from n with small prime factors only."""
    return int(_lengths()[np.searchsorted(_lengths(), n)])


@functools.lru_cache(maxsize=4)
def _disk(rows: int, cols: int, r: float) -> np.ndarray:
    """Transform of the disk around the origin, the axes wrapped around; real, as the disk is symmetric."""
    i, j = (np.minimum(np.arange(n), n - np.arange(n)).astype(float) for n in (rows, cols))
    return np.fft.rfft2((i[:, None] ** 2 + j**2 <= r * r).astype(float)).real.copy()


def _limbs(v: np.ndarray, bits: int) -> list[np.ndarray]:
    """v as whole numbers of up to ``bits`` bits and a sign, the lowest first: their sum, each times 2**bits to its place, is v."""
    out = []
    while True:
        if np.abs(v).max(initial=0) <= 1 << (bits - 1):
            return [*out, v.astype(float)]
        if v.dtype.kind == "f":
            high = np.rint(v / float(1 << bits))
            out.append(v - high * float(1 << bits))
        else:
            high = (v + (1 << (bits - 1))) >> bits
            out.append((v - (high << bits)).astype(float))
        v = high


def _window(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[float, float, float, float]:
    """First column and row, columns and rows of the lattice that the disks touch."""
    a, b = x.min() - reach, y.min() - reach
    return a, b, x.max() + reach - a + 1, y.max() + reach - b + 1


def pays(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, columns: int, radii: list[float], strips: int) -> bool:
    """Whether all places are on the lattice, and transforms are faster than so many strips in each radius."""
    a, b, wide, high = _window(x, y, math.floor(radii[-1]))
    if not (wide * high <= MOST and max(abs(a), abs(b)) < 1 << 50):
        return False
    by_strips = len(x) * sum(2 * strips * r / radii[-1] + 3 for r in radii) * (STRIP_NS + COLUMN_NS * columns)
    if _length(math.ceil(wide)) * _length(math.ceil(high)) * CELL_NS * (1 + len(radii)) * 1.5 * columns > by_strips:
        return False
    return all((c == np.floor(c)).all() for c in (x, y, ux, uy))


def disk_sums(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, values: list[np.ndarray], radii: list[float]) -> list[list[np.ndarray]] | None:
    """As ``strips.disk_sums``, for coordinates in whole numbers; None where sums wouldn't be certain."""
    reach = math.floor(radii[-1])
    a, b, wide, high = _window(x, y, reach)
    cols, rows = _length(int(wide)), _length(int(high))
    some = (ux >= a) & (ux < a + wide) & (uy >= b) & (uy < b + high)
    at = (uy[some] - b).astype(np.int64) * cols + (ux[some] - a).astype(np.int64)
    mine = (y - b).astype(np.int64) * cols + (x - a).astype(np.int64)
    norm = math.sqrt(max(1, len(at))) * (2 * reach + 1)
    bits = min(48, math.floor(math.log2(_AIM / (_ROUNDING * norm))))
    if bits < 8:
        return None
    found = [[] for _ in radii]
    for v in values:
        totals = [[] for _ in radii]
        for limb in _limbs(v[some], bits):
            image = np.fft.rfft2(np.bincount(at, limb, rows * cols).reshape(rows, cols))
            for total, r in zip(totals, radii, strict=True):
                sums = np.fft.irfft2(image * _disk(rows, cols, r), s=(rows, cols)).ravel()[mine]
                near = np.rint(sums)
                if np.abs(sums - near).max(initial=0.0) > _SEEN:
                    return None
                total.append(near.astype(np.int64))
        for told, total in zip(found, totals, strict=True):
            if v.dtype.kind == "f":
                told.append(functools.reduce(lambda s, t: s * float(1 << bits) + t, (t.astype(float) for t in reversed(total))))
            else:
                told.append(functools.reduce(lambda s, t: (s << bits) + t, reversed(total)))
    return found
