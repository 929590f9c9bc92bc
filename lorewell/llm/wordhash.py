"""Hashes of words and of runs of words, for tasks that work on whole texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at just the six characters that part words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of 64 places of a word.
_PLACES = 64
_TABLE = mixed(np.arange(_PLACES * 256, dtype=np.uint64), 21)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _of_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of some bytes, and where it starts: the sum of its bytes' numbers, mixed with its length."""
    x = np.frombuffer(raw, np.uint8)
    of_word = ~_SPACE[x]
    starts = np.flatnonzero(of_word & np.append(True, ~of_word[:-1])) if len(x) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(of_word)
    firsts = np.searchsorted(at, starts)
    lengths = np.diff(np.append(firsts, len(at)))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    numbers = _TABLE[(place & (_PLACES - 1)) << 8 | x[at]]
    if lengths.max() > _PLACES:
        numbers *= ((place // _PLACES) * 2 + 1).astype(np.uint64)
    return mixed(np.add.reduceat(numbers, firsts) ^ (lengths.astype(np.uint64) << np.uint64(40)), 5), starts


def text_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, one text after another, and how many words each has."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    ends = np.cumsum([len(x) + 1 for x in raw]) if raw else np.empty(0, np.int64)
    whole = b" ".join(raw)
    h, starts = _of_bytes(whole.translate(_LOWER) if lower else whole)
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)


def hashes(words: list[bytes]) -> np.ndarray:
    return _of_bytes(b" ".join(words))[0]


def runs(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """One hash for each run of n of the hashes h, in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = (out + h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        out ^= out >> np.uint64(32)
    return mixed(out, seed)


def digest(h: np.ndarray, seed: int) -> int:
    """A signed 64-bit digest of a sequence of hashes."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), seed))))
