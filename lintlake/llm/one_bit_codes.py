"""Rotated one-bit codes of vectors, and bounds of inner products from them.

A vector is turned by a random rotation and each coordinate kept as its sign. The code stands for the
vector c of length 1 with these signs; stored with it is the alignment g = <x, c>. What is left,
x - g c, is at right angles to c; it is coded again under the next rotation, level by level, and
the length of each rest is kept. So x = g1 c1 + ... + gL cL + r, and

    <q, x> = g1 <q, c1> + ... + gL <q, cL> + <q, r>.

<q, c> is estimated by popcounts: the turned query is rounded to ``BITS`` bit planes, and a plane's part
is the number of set bits it shares with the code. The rounding error is bounded by its length, and
|<q, r>| by Cauchy and Schwarz: r is at right angles to the last c, so only q's part off c counts.
Bounds therefore always hold; they are widened a little for the rounding of doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEVELS = 8
BITS = 6
#: Bounds are widened by this share of the lengths' product, and by it itself.
SLACK = 1e-9


def _rotation(width: int, level: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([11, level]).normal(size=(width, width)))[0]


@dataclass
class Codes:
    """Codes of many vectors: words (level, row, word), alignments and rests (level, row)."""

    words: np.ndarray
    gains: np.ndarray
    rests: np.ndarray
    lengths: np.ndarray


@dataclass
class Queries:
    """Queries, level by level: bit planes (level, query, plane, word), scales and rounding errors (level, query)."""

    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    sums: np.ndarray
    errors: np.ndarray
    lengths: np.ndarray


class OneBitCoder:
    def __init__(self, width: int, levels: int = LEVELS):
        self.width, self.levels = width, levels
        self.padded = -(-width // 64) * 64
        self.rotations = [_rotation(self.padded, level) for level in range(levels)]

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors.astype(np.float64), ((0, 0), (0, self.padded - self.width)))

    def encode(self, vectors: np.ndarray) -> Codes:
        rest = self._padded(vectors)
        words, gains, rests = [], [], []
        lengths = np.linalg.norm(rest, axis=1)
        for rotation in self.rotations:
            turned = rest @ rotation.T
            signs = turned >= 0
            code = np.where(signs, 1.0, -1.0) / np.sqrt(self.padded)
            gain = (turned * code).sum(axis=1)
            rest = (turned - gain[:, None] * code) @ rotation
            words.append(np.packbits(signs, axis=1, bitorder="little").view(np.uint64))
            gains.append(gain)
            rests.append(np.linalg.norm(rest, axis=1))
        return Codes(np.array(words), np.array(gains), np.array(rests), lengths)

    def queries(self, vectors: np.ndarray) -> Queries:
        padded = self._padded(vectors)
        parts = []
        for rotation in self.rotations:
            turned = padded @ rotation.T
            low = turned.min(axis=1)
            step = (turned.max(axis=1) - low) / (2**BITS - 1)
            step[step == 0] = 1.0
            levels = np.rint((turned - low[:, None]) / step[:, None])
            errors = np.linalg.norm(turned - low[:, None] - step[:, None] * levels, axis=1)
            bits = levels.astype(np.int64)[:, None, :] >> np.arange(BITS)[:, None] & 1
            planes = np.packbits(bits.astype(bool), axis=2, bitorder="little").view(np.uint64)
            parts.append((planes, low, step, levels.sum(axis=1), errors))
        return Queries(*(np.array(own) for own in zip(*parts)), np.linalg.norm(padded, axis=1))

    def add(self, codes: Codes, queries: Queries, n: int, level: int, rows: np.ndarray, estimate, error):
        """Estimates of the rows' products with query n and their errors, one level further, and <q, c>."""
        words = codes.words[level][rows]
        shared, ones = np.zeros((2, len(words)), np.int32 if self.padded > 512 else np.uint16)
        for w in range(words.shape[1]):
            own = words[:, w]
            ones += np.bitwise_count(own)
            for b, plane in enumerate(queries.planes[level, n, :, w]):
                shared += np.left_shift(np.bitwise_count(own & plane), b, dtype=shared.dtype)
        low, step, gains = queries.low[level, n], queries.step[level, n], codes.gains[level][rows]
        scale = 2.0 / np.sqrt(self.padded)
        with_code = shared * (step * scale) + ones * (low * scale)
        with_code -= (low * self.padded + step * queries.sums[level, n]) * scale / 2
        return estimate + gains * with_code, error + np.abs(gains) * queries.errors[level, n], with_code

    def reach(self, codes: Codes, queries: Queries, n: int, level: int, rows: np.ndarray, error, with_code) -> np.ndarray:
        """How far the rows' products can be from their estimates."""
        along = np.maximum(np.abs(with_code) - queries.errors[level, n], 0.0)
        across = np.sqrt(np.maximum(queries.lengths[n] ** 2 - along**2, 0.0))
        return error + across * codes.rests[level][rows] + SLACK * (queries.lengths[n] * codes.lengths[rows] + 1)
