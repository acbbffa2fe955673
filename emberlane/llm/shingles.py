"""Sets of five-word shingles as 64-bit numbers, many texts at once."""

from __future__ import annotations

import functools

import numpy as np

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def _letters() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


@functools.cache
def _factors() -> np.ndarray:
    return _mixed(np.arange(1000, 1001 + WIDTH, dtype=np.uint64) * _ODD) | np.uint64(1)


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < size:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, dtype=np.uint64)])) for base in (_ODD, inverse)]
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle numbers of each whole text.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than five words is one shingle, a text
    without words none.
    """
    words = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b" ".join([w for ws in words for w in ws] + [b""]), dtype=np.uint8)
    total = int(sizes.sum())
    if not total:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    powers, inverses = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_letters()[data] * powers[: len(data)])])
        ends = np.flatnonzero(data == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = _mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
        whole = np.zeros(max(0, total - WIDTH + 1), dtype=np.uint64)
        for j in range(WIDTH):
            whole += hashes[j : j + len(whole)] * _factors()[j]
        whole = _mixed(whole)
        result, at = [], 0
        for n in sizes.tolist():
            if n >= WIDTH:
                result.append(np.unique(whole[at : at + n - WIDTH + 1]))
            elif n:
                short = (hashes[at : at + n] * _factors()[:n]).sum(dtype=np.uint64) + np.uint64(n) * _factors()[WIDTH]
                result.append(_mixed(np.array([short], dtype=np.uint64)))
            else:
                result.append(np.empty(0, dtype=np.uint64))
            at += n
    return result


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash values, one row for each (non-empty) set."""
    if not sets:
        return np.zeros((0, coordinates), dtype=np.uint32)
    flat = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    factors = _mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    result = np.empty((len(sets), coordinates), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(factors):
            result[:, k] = np.minimum.reduceat(flat * factor, offsets) >> np.uint64(32)
    return result
