"""Words and word shingles of texts, as 64-bit hashes in numpy; for code in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

#: A-Z become a-z; every other ASCII character that is no letter or digit parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """The lower-cased words of a text: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.encode().translate(_FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """text -> its word shingles as uint64 hashes, in order.  A text of fewer words than ``size``, but not none,
    has one shingle of all its words."""

    def __init__(self, size: int = 5):
        self.size = size
        self.known = Memo(xxhash.xxh3_64_intdigest, 100_000)

    def hashes(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def of_words(self, found: list[bytes]) -> np.ndarray:
        h = self.hashes(found)
        if not len(h):
            return h
        size = min(self.size, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.of_words(words(text))
