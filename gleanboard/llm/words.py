"""Word hashes of whole texts, vectorised over a batch.

A word is a maximal run without ASCII white space. Every word gets a 64-bit
hash of its bytes, equal in every task; two different words share one with a
chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes that are hashed at a time; a longer text is hashed alone.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


class WordHasher:
    """Hashes the words of lists of texts; keeps its power tables between calls."""

    def __init__(self, lower: bool, also: bytes = b""):
        """``also``: further bytes that end a word."""
        folded = np.arange(256)
        if lower:
            folded[65:91] += 32
        self.value = mix(folded.astype(U) + U(0x9E3779B97F4A7C15))
        self.space = np.zeros(256, dtype=bool)
        self.space[list(SPACE_BYTES + also)] = True
        self.base = 0x5851F42D4C957F2D
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, r in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, U(r))
                steps[0] = U(1)
                setattr(self, name, np.cumprod(steps, dtype=U))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, bounds of every text in them); null texts have no words."""
        hashes, counts, part, size = [], [np.zeros(1, dtype=np.int64)], [], 0
        for text in texts:
            part.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
            size += len(part[-1]) + 1
            if size >= SLICE_BYTES:
                self._slice(part, hashes, counts)
                part, size = [], 0
        self._slice(part, hashes, counts)
        return np.concatenate([np.zeros(0, dtype=U), *hashes]), np.cumsum(np.concatenate(counts))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of every word [start, end) of some bytes."""
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:], dtype=U)
        h = (sums[end] - sums[start]) * self.down[start]
        return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def _slice(self, part: list[bytes], hashes: list, counts: list) -> None:
        if not part:
            return
        data = np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)
        space = self.space[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        start, end = edge[0::2], edge[1::2]
        hashes.append(self.words(data, start, end))
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
        counts.append(np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words (len(words) - width + 1 of them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    h = np.full(n, U(width))
    for k in range(width):
        h = h * U(0xD6E8FEB86659FD93) + words[k: k + n]
    return mix(h)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text; of fewer words than ``width``, the whole sequence."""
    every = shingles(words, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(every[a: b - width + 1])
        elif b > a:
            yield shingles(words[a:b], b - a)
        else:
            yield np.zeros(0, dtype=U)
