"""Words of many texts as arrays of 64-bit hashes, worked out over whole slices of bytes in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MIX = np.random.default_rng(20240607)
BYTE_CODES = MIX.integers(0, 2**64, 256, np.uint64)
STEP = np.uint64(MIX.integers(0, 2**63) * 2 + 1)
# ASCII letters in lower case, digits and bytes of other letters stay; other ASCII separates words
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@lru_cache(maxsize=4)
def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 .. n-1, modulo 2**64."""
    steps = np.full(n, STEP, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and where each text's words begin, with the total at the end.

    Words are runs of letters and digits of any script, in lower case.
    """
    return hashes_of([t.lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES) + b" " for t in batch])


def hashes_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts given as bytes that end in a space and have no other separator."""
    flat = np.frombuffer(b"".join(raw), np.uint8)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    full = flat != 32
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    starts = np.flatnonzero(begins)
    text_ends = np.cumsum([len(r) for r in raw])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    gaps = np.diff(np.append(starts, len(flat)))
    longest = 1 << int(gaps.max()).bit_length()
    place = np.arange(starts[0], len(flat)) - np.repeat(starts, gaps)
    codes = BYTE_CODES.copy()
    codes[32] = 0
    mixed = codes[flat[starts[0] :]] * powers(longest)[place]
    hashes = np.add.reduceat(mixed, starts - starts[0])
    return finish(hashes), bounds


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))
