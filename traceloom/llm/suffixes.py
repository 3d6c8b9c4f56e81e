"""Suffix arrays, common prefixes and window anchors of bytes in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from traceloom.llm.words import BYTE_CODES, STEP, finish

BACK = np.uint64(pow(int(STEP), -1, 2**64))


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Positions of ``x`` (symbols from 0) sorted by their suffixes.

    Larsson-Sadakane refinement: positions are sorted by their first symbols; then only groups that are still equal are sorted
    by the rank of the position one sorted length further on, which doubles the length each time.
    """
    n = len(x)
    bits = int(x.max(initial=1)).bit_length()
    length = max(1, 62 // bits)  # symbols in the first sort key
    padded = np.concatenate([x.astype(np.int64), np.zeros(length, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(length):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    heads = np.concatenate([[True], key[order][1:] != key[order][:-1]])[:n]
    rank = np.zeros(2 * n + 1, np.int64)  # past the end all ranks are 0, below those of the text
    first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = first + 1
    sizes = np.bincount(first, minlength=n)
    open_slots = np.flatnonzero(sizes[first] > 1)
    while len(open_slots):
        at = order[open_slots]
        group, further = rank[at], rank[np.minimum(at + length, 2 * n)]
        by = np.argsort(group * (n + 2) + further)
        at, group, further = at[by], group[by], further[by]
        order[open_slots] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
        first = np.maximum.accumulate(np.where(new, open_slots, 0))
        rank[at] = first + 1
        run = np.flatnonzero(new)
        counts = np.diff(np.append(run, len(new)))
        open_slots = open_slots[np.repeat(counts > 1, counts)]
        length *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each place of the suffix array the common prefix with the place before, counted up to ``most``; symbol 0 ends a text.

    Kasai's method: going one position on in a text shortens its common prefix by one at most. The texts (``starts`` and ``sizes``)
    are gone through side by side.
    """
    n = len(x)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    padded = np.concatenate([x, np.zeros(most + 17, x.dtype)])
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    same = np.zeros(len(starts), np.int64)
    ahead = np.arange(16)
    for t in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:alive] + t
        slot = place[at]
        before = order[np.maximum(slot - 1, 0)]
        h = np.maximum(same[:alive] - 1, 0)
        h[slot == 0] = 0
        going = np.flatnonzero((slot > 0) & (h < most))
        while len(going):
            a, b = at[going] + h[going], before[going] + h[going]
            first = (padded[a] == padded[b]) & (padded[a] != 0)
            going, a, b = going[first], a[first], b[first]
            if not len(going):
                break
            left, right = padded[a[:, None] + ahead], padded[b[:, None] + ahead]
            stop = (left != right) | (left == 0)
            run = np.where(stop.any(axis=1), stop.argmax(axis=1), 16)
            h[going] = np.minimum(h[going] + run, most)
            going = going[(run == 16) & (h[going] < most)]
        same[:alive] = h
        out[slot] = h
    return out


@lru_cache(maxsize=2)
def both_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash step and of its inverse modulo 2**64."""
    out = []
    for base in (STEP, BACK):
        steps = np.full(size, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


class Hashed:
    """Hashes of any range of a byte array, or of an array of 64-bit codes."""

    def __init__(self, flat: np.ndarray):
        codes = BYTE_CODES[flat] if flat.dtype == np.uint8 else flat
        size = 1 << max(10, int(len(flat) + 1).bit_length())
        self.up, self.down = both_powers(size)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(flat)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def grams(self, size: int) -> np.ndarray:
        """The hash of every range of ``size`` bytes."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.down[:n]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring values."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchored_windows(flat: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The windows of all texts of bytes, gathered by anchor."""
    return anchored(Hashed(flat), bounds, window, gram)


def anchored(hashed: Hashed, bounds: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The windows of all texts, gathered by anchor.

    A window's anchor is its gram with the least hash, the leftmost of equals; equal windows so have equal anchors at equal places.
    Neighbouring windows with the same anchor make one stretch: ``text`` it lies in, its first window's ``start``, the number of
    ``windows``, the ``place`` of the gram, the ``anchor`` hash and the ``content`` hash of all bytes of the stretch and the anchor's place in them.
    """
    names = ("text", "start", "windows", "place", "anchor", "content")
    sizes = np.diff(bounds)
    if sizes.max(initial=0) < window:
        return {name: np.zeros(0, np.uint64 if name in ("anchor", "content") else np.int64) for name in names}
    grams = finish(hashed.grams(gram))
    low = np.uint64(0xFFFFFFFF)
    least = sliding_minimum(grams & ~low | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    at = (least & low).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= window:
            valid[begin : end - window + 1] = True
    fresh = valid[:-1].copy()
    fresh[1:] &= ~valid[:-2] | (at[1:] != at[:-1])
    start = np.flatnonzero(fresh)
    windows = np.bincount(np.cumsum(fresh)[valid[:-1]] - 1, minlength=len(start))
    place = at[start]
    content = hashed.ranges(start, start + windows + window - 1)
    content ^= (place - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) ^ windows.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    text = np.searchsorted(bounds, start, side="right") - 1
    return dict(zip(names, (text, start, windows, place, grams[place], finish(content)), strict=True))
