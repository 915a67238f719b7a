"""Words of a text and their hashes, for use inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd multipliers of the two independent rolling hashes.
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def split_words(text: str) -> list[bytes]:
    """Runs without the characters 0x20 and 0x09 to 0x0D, as UTF-8.

    These are exactly the separators of ``bytes.split``; no byte of a longer
    UTF-8 sequence is among them.
    """
    return text.encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hash(hashes: np.ndarray, window: int, base: np.uint64 = BASE_A) -> np.ndarray:
    """Rabin-Karp hash of every ``window`` consecutive word hashes (mod 2**64).

    h(i) = w[i] * b**(window-1) + ... + w[i+window-1].  The word hashes are
    uniform 64-bit values, so two different windows agree with probability
    about 2**-64.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out *= base
        out += hashes[j : j + n]
    return out
