"""Words of many texts at once, from their UTF-8 bytes, with 64-bit hashes.

A word's hash is a polynomial of random numbers that stand for its bytes, taken from running sums over the
block of bytes it lies in, so there is no step per word. Different words have the same hash with a probability
of about 2 ** -64; two hashers with different seeds are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one go; also about how many bytes of texts go together.
BLOCK = 1 << 20
TURN = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a number made to depend on all others (the finishing steps of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Rolling:
    """Hashes of stretches of a sequence of numbers, each from two running sums."""

    def __init__(self, seed: int):
        self.base = int(np.random.default_rng(seed).integers(0, 1 << 62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            factors = np.full(n, self.base, np.uint64)
            factors[0] = 1
            self.up = np.cumprod(factors)
            factors[1:] = pow(self.base, -1, 1 << 64)
            self.down = np.cumprod(factors)

    def stretches(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.down[: len(values)])])
        return mixed((sums[ends] - sums[starts]) * self.up[starts])


class Words:
    """Cuts bytes into words at ``blanks`` and ``breaks``; a break also ends a piece."""

    def __init__(self, blanks: bytes, breaks: bytes = b"", seed: int = 1):
        self.apart = np.zeros(256, bool)
        self.apart[list(blanks + breaks)] = True
        self.breaks = np.zeros(256, bool)
        self.breaks[list(breaks)] = True
        self.letters = np.random.default_rng(seed).integers(1, 1 << 63, 256).astype(np.uint64)
        self.rolling = Rolling(seed + 1)

    def split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word, and the byte after its last."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.apart[data]
        turns = np.diff(inside)
        return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found, at = [], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
            low, high = int(starts[at]), int(ends[to - 1])
            found.append(self.rolling.stretches(self.letters[data[low:high]], starts[at:to] - low, ends[at:to] - low))
            at = to
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of breaks before each word."""
        return np.searchsorted(np.flatnonzero(self.breaks[data]), starts)


def portions(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with some ``BLOCK`` bytes of text, and these texts (null: empty)."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
        first, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK or k == len(texts) - 1:
                yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                first, size = k + 1, 0


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with a line feed after each, and the place after each of these."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), ends
