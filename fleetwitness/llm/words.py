"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from fleetwitness.llm.spans import Memory

WORD = Memory(xxhash.xxh3_64_intdigest, 300_000)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` in order, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | list[bytes] | None) -> np.ndarray:
    """One hash per word of a text, or of words."""
    words = text if isinstance(text, list) else words_of(text)
    return np.fromiter(map(WORD.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words; fewer words are one run; no words, none."""
    runs = len(words) - size + 1
    if runs <= 0:
        runs, size = min(1, len(words)), len(words)
    out = np.full(runs, np.uint64(size))
    for k in range(size):
        out = mix(out + words[k : k + runs])
    return out
