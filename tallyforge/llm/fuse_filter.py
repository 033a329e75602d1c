"""Static 3-wise binary fuse filters with 8-bit fingerprints over 64-bit keys (Graf and Lemire, 2022)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ._text import mix64

_U64 = np.uint64


@dataclass(frozen=True)
class FuseFilter:
    """Says of every key it was built from that it may be there, and of about 1 in 256 others."""

    seed: int
    segment: int
    starts: int
    fingerprints: np.ndarray

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three places of each key, in three successive segments, and its fingerprint."""
        h = mix64(keys ^ _U64(self.seed))
        first = (((h >> _U64(32)) * _U64(self.starts)) >> _U64(32)).astype(np.int64)
        mask = self.segment - 1
        second = (first + self.segment) ^ ((h >> _U64(18)).astype(np.int64) & mask)
        third = (first + 2 * self.segment) ^ (h.astype(np.int64) & mask)
        return np.stack((first, second, third)), (h ^ (h >> _U64(32))).astype(np.uint8)

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.fingerprints):
            return np.zeros(len(keys), dtype=bool)
        at, marks = self.places(keys)
        return marks == np.bitwise_xor.reduce(self.fingerprints[at], axis=0)


def build(keys: np.ndarray) -> FuseFilter:
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 4, 0, np.zeros(0, dtype=np.uint8))
    segment = min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(1, 1000):
        made = FuseFilter(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments * segment, np.zeros((segments + 2) * segment, dtype=np.uint8))
        at, marks = made.places(keys)
        peeled = _peel(at, n, len(made.fingerprints))
        if peeled is None:
            continue
        # the places a round's keys leave open are theirs alone, so a whole round is filled at once
        for found, own in reversed(peeled):
            made.fingerprints[own] = 0
            made.fingerprints[own] = marks[found] ^ np.bitwise_xor.reduce(made.fingerprints[at[:, found]], axis=0)
        return made
    raise ValueError("no seed gives a filter")


def _peel(at: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, a place that no remaining key shares), or None if some keys stay entangled."""
    count = np.bincount(at.ravel(), minlength=size)
    total = np.bincount(at.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
    alone, rounds, left = np.flatnonzero(count == 1), [], n
    while len(alone):
        found, first = np.unique(total[alone], return_index=True)
        rounds.append((found, alone[first]))
        left -= len(found)
        touched = at[:, found].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(found, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return None if left else rounds
