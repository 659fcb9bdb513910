"""Rolling hashes over code points or words, in numpy, shared by the text operators."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += _BASE
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of all stretches of given lengths of one sequence of 64-bit values.

    Stretches of powers of two are built by doubling; another length is put together from them.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [mixed(values)]
        self.powers = [_BASE | np.uint64(1)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, p, step = self.levels[-1], self.powers[-1], 1 << (len(self.levels) - 1)
            self.levels.append(h[: max(0, len(h) - step)] * p + h[step:])
            with np.errstate(over="ignore"):
                self.powers.append(p * p)
        return self.levels[k]

    def of(self, length: int) -> np.ndarray:
        """The hash of the stretch of ``length`` values from each position where one begins."""
        n = len(self.levels[0]) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, done, k = None, 0, 0
        for k in range(length.bit_length()):
            if length >> k & 1:
                part = self._level(k)[done : done + n]
                # the stretch so far stands to the left, so it is scaled by the power of what follows
                out = part.copy() if out is None else out * self.powers[k] + part
                done += 1 << k
        return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, by doubling."""
    if len(x) < width:
        return x[:0]
    m, step = x, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def code_points(text: str) -> np.ndarray:
    """The code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
