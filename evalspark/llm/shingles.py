"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
_CACHED_WORDS = 100_000
# Letters A-Z in lower case; words are separated by white space of ASCII, as bytes.split does it.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


class _Memo(dict):
    """Hashes of words, computed at first sight."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Memo()
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WORDS_PER_SHINGLE + 1)], dtype=np.uint64)


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > _CACHED_WORDS:
        _words.clear()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, one without words none."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = _hashes(words)
    size = min(len(hashes), WORDS_PER_SHINGLE)
    count = len(hashes) - size + 1
    out = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : k + count] * _FACTORS[k]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_digest(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes())
