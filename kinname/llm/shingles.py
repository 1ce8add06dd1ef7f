"""Word and shingle hashes of texts, on NumPy arrays; the same in every process."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from kinname.llm.common import Memo

WORDS = 5
_word = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 100_000, "shingles")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))


def _made(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.where(np.arange(size) > 0, x, np.uint64(1)), dtype=np.uint64) for x in (_STEP, _INVERSE))


_kept = lru_cache(_made)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2^64; those for texts of usual lengths are kept."""
    return _kept(size) if size <= 1 << 16 else _made(size)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words; of all words together if there are fewer; none of no words.

    A run is the number whose digits are its words' hashes, modulo 2^64, as the difference of two
    running sums; so the cost does not grow with k.
    """
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.cumsum(hashes * down[:n])
    runs = sums[k - 1 :].copy()
    runs[1:] -= sums[: n - k]
    return mix(runs * up[: n - k + 1] + np.uint64(k))


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    return run_hashes(word_hashes(text.split()), k)
