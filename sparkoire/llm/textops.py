"""Vectorised hashing of words, shingles and windows for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The six white-space bytes: space, and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
U = np.uint64
#: Bytes of text that one vectorised step takes at least, so that memory follows the longest text and not the batch.
STEP_BYTES = 1 << 20


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return splitmix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


class Tables:
    """Per-process tables: classes and codes of bytes, powers of the hash base."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.codes = constants(256, 7)
        self.lower = self.codes.copy()
        self.lower[65:91] = self.codes[97:123]
        self.base = U(0xD6E8FEB86659FD93)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.powers = self.unpowers = np.ones(0, U)

    def grow(self, n: int) -> None:
        if self.powers.size < n:
            n = max(n, 2 * self.powers.size)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.base, U)]))
                self.unpowers = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, self.inverse, U)]))


def prefixes(data: np.ndarray, codes: np.ndarray, tables: Tables) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    tables.grow(data.size + 1)
    out = np.zeros(data.size + 1, U)
    np.cumsum(codes[data] * tables.powers[: data.size], out=out[1:])
    return out


def steps(texts: list[bytes], least: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold ``least`` bytes, or one text if it's longer."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= least:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def words(texts: list[bytes], tables: Tables, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, the first word of each text (one more at the end), and each word's begin and end in ``b" ".join``.

    Words are runs of other bytes than SPACES; ``lower`` folds A-Z.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    space = tables.space[data]
    edge = np.empty(data.size + 1, bool)
    if data.size:
        edge[0], edge[-1] = ~space[0], ~space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    else:
        edge[:] = False
    at = np.flatnonzero(edge)
    begin, end = at[::2], at[1::2]
    sums = prefixes(data, tables.lower if lower else tables.codes, tables)
    hashes = splitmix((sums[end] - sums[begin]) * tables.unpowers[begin] + (end - begin).astype(U))
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    starts[-1] = data.size + 1
    return hashes, np.searchsorted(begin, starts), begin, end


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of k words from each place on; k - 1 places fewer than words (none if there are fewer than k)."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, U)
    factors = constants(k, seed) | U(1)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * factors[j]
    return splitmix(out)


def sequence(hashes: np.ndarray, seed: int) -> np.uint64:
    """Hash of a whole sequence, its length included."""
    n = hashes.size
    total = np.add.reduce(hashes * (constants(n, seed) | U(1)), keepdims=True, dtype=U)
    return splitmix(total + np.full(1, n, U) * U(0xA24BAED4963EE407))[0]
