"""Words as numbers, for operators that compare texts word by word."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo, claim

PUNCTUATION = ".,;:!?\"'()[]{}<>*#%$&-_/\\|"
CACHE_ENTRIES = 300_000
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3
MASK = (1 << 64) - 1

#: A visible run in lower case to the hash of the word in it, without punctuation around it.
_numbers = Memo(lambda run: xxhash.xxh64_intdigest(run.strip(PUNCTUATION) or run), CACHE_ENTRIES)


def word_ids(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in lower case and without punctuation around it."""
    claim("words", _numbers.clear)
    runs = text.lower().split() if text else []
    return np.fromiter(map(_numbers.__getitem__, runs), np.uint64, len(runs))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of x."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row; of all words where there are fewer."""
    if not len(ids):
        return ids
    size = min(n, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_STEP) + ids[k : len(ids) - size + 1 + k]
    return mixed(out)
