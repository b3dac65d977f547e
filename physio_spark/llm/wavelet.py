"""Wavelet matrix: a sequence of small integers as bit-planes that answer access, rank and select.

Plane 0 holds every number's highest bit in the order of the sequence.  Each further plane holds the next
bit after a stable partition by the bit before, zeros first.  A plane is packed bits (lowest first, in
blocks of 512) and the number of ones before each block; both are all that a query reads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 512
WORDS = BLOCK // 64
# Places that one vectorised step takes: of queries, and of the sweeps that part and merge planes in cache.
STEP = 1 << 16
SWEEP = 1 << 15


@dataclass
class Plane:
    """One bit-plane of ``n`` bits with its directory of ones."""

    words: np.ndarray
    before: np.ndarray
    zeros: int

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        blocks = -(-max(len(bits), 1) // BLOCK)
        words = np.frombuffer(packed.tobytes().ljust(blocks * BLOCK // 8, b"\0"), "<u8").reshape(blocks, WORDS)
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        return cls(words, np.cumsum(ones) - ones, len(bits) - int(ones.sum()))

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8).ravel(), bitorder="little", count=n).view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words.ravel()[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).view(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (a place may be the plane's end)."""
        block = np.minimum(at // BLOCK, len(self.words) - 1)
        inside = at - block * BLOCK
        left = np.clip(inside[:, None] - np.arange(0, BLOCK, 64), 0, 64)
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.words[block] & mask).sum(1, dtype=np.int64)

    def select(self, bit: int, nth: np.ndarray) -> np.ndarray:
        """The place of each ``nth`` (from 0) bit that is ``bit``; all must exist."""
        ahead = self.before if bit else np.arange(len(self.words)) * BLOCK - self.before
        block = np.searchsorted(ahead, nth, "right") - 1
        own = np.unpackbits(self.words[block].view(np.uint8), axis=1, bitorder="little") == bit
        inside = np.argmax(np.cumsum(own, axis=1, dtype=np.int32) > (nth - ahead[block])[:, None], axis=1)
        return block * BLOCK + inside


def _sides(bits: np.ndarray):
    """Stretches of a plane: where each begins, and the places of its zeros and of its ones."""
    for lo in range(0, len(bits), SWEEP):
        some = bits[lo : lo + SWEEP]
        yield lo, np.flatnonzero(~some), np.flatnonzero(some)


def _part(values: np.ndarray, bits: np.ndarray, zeros: int) -> np.ndarray:
    """The numbers at zeros, then those at ones, each in their order."""
    out, a, b = np.empty_like(values), 0, zeros
    for lo, no, yes in _sides(bits):
        own = values[lo : lo + SWEEP]
        out[a : a + len(no)], out[b : b + len(yes)] = own[no], own[yes]
        a, b = a + len(no), b + len(yes)
    return out


def _merge(values: np.ndarray, bits: np.ndarray, zeros: int, mark: int) -> np.ndarray:
    """What :func:`_part` was given, with ``mark`` set in the numbers at ones."""
    out, a, b = np.empty_like(values), 0, zeros
    for lo, no, yes in _sides(bits):
        own = out[lo : lo + SWEEP]
        own[no], own[yes] = values[a : a + len(no)], values[b : b + len(yes)] | values.dtype.type(mark)
        a, b = a + len(no), b + len(yes)
    return out


def _stepwise(run, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.int64)
    for lo in range(0, len(at), STEP):
        out[lo : lo + STEP] = run(at[lo : lo + STEP])
    return out


class WaveletMatrix:
    """``n`` numbers below ``2 ** len(planes)``."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        planes, rest = [], values
        for shift in range(width - 1, -1, -1):
            bits = (rest & rest.dtype.type(1 << shift)) != 0
            planes.append(Plane.of(bits))
            rest = _part(rest, bits, planes[-1].zeros) if shift else rest
        return cls(len(values), planes)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The number at each place."""

        def run(place: np.ndarray) -> np.ndarray:
            out = np.zeros(len(place), np.int64)
            for plane in self.planes:
                bit, ones = plane.get(place), plane.rank(place)
                place = np.where(bit == 1, plane.zeros + ones, place - ones)
                out = out << 1 | bit
            return out

        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the sequence")
        return _stepwise(run, at)

    def _node(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """The run, below the last plane, of the occurrences of a value within [lo, hi)."""
        for i, plane in enumerate(self.planes):
            ones = plane.rank(np.array([lo, hi]))
            if value >> len(self.planes) - 1 - i & 1:
                lo, hi = (plane.zeros + ones).tolist()
            else:
                lo, hi = (np.array([lo, hi]) - ones).tolist()
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a value occurs in [lo, hi)."""
        if not 0 <= value < 1 << len(self.planes):
            return 0
        a, b = self._node(value, lo, self.n if hi is None else hi)
        return b - a

    def select(self, value: int, nth: np.ndarray) -> np.ndarray:
        """The places of the given occurrences (from 0) of a value, in order of place."""
        nth = np.asarray(nth, np.int64)
        a, b = self._node(value, 0, self.n) if 0 <= value < 1 << len(self.planes) else (0, 0)
        if len(nth) and (nth.min() < 0 or nth.max() >= b - a):
            raise IndexError("no such occurrence")

        def run(some: np.ndarray) -> np.ndarray:
            place = a + some
            for i, plane in enumerate(reversed(self.planes)):
                place = plane.select(1, place - plane.zeros) if value >> i & 1 else plane.select(0, place)
            return place

        return _stepwise(run, nth)

    def find(self, value: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of a value in [lo, hi), ascending."""
        first = self.count(value, 0, lo)
        return self.select(value, np.arange(first, first + self.count(value, lo, hi)))

    def decode(self, kind: type = np.uint32) -> np.ndarray:
        """The whole sequence: planes merged from the lowest upwards, each in one sweep."""
        out = np.zeros(self.n, kind)
        for i, plane in enumerate(reversed(self.planes)):
            out = _merge(out, plane.bits(self.n), plane.zeros, 1 << i)
        return out
