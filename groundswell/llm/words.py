"""Words of many texts at once: runs of digits, letters and non-ASCII bytes, with A-Z lower-cased."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

# Byte -> lower-cased byte, or 0 between words.
FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b).lower().encode()[0] if _b < 128 else _b
    if _b >= 128 or 0x30 <= _c <= 0x39 or 0x61 <= _c <= 0x7A:
        FOLD[_b] = _c
SPACED = bytes(int(b) or 0x20 for b in FOLD)


def word_list(text: bytes) -> list[bytes]:
    return text.translate(SPACED).split()


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """Word bounds and 64-bit word hashes of several texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\0".join(texts)
        folded = FOLD[np.frombuffer(self.raw + b"\0", np.uint8)]
        inside = np.flatnonzero(np.diff((folded != 0).view(np.int8), prepend=np.int8(0)))
        self.folded = folded.tobytes()
        self.starts, self.ends = inside[0::2], inside[1::2]
        n = len(folded)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(folded * _power(_BASE, n)[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n)[self.starts])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, edges)  # first word of each text, and the end

    def word(self, i: int) -> bytes:
        return self.folded[self.starts[i] : self.ends[i]]

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave a text are not marked."""
        n = max(0, len(self.hashes) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[i : i + n]
        return mix(h)
