"""Names of strings by doubling, and pointers: a sample of positions of which every window owns exactly one.

A unit is a byte or a word, given by a 64-bit name. The name of a longer string is made of the names of two shorter ones
at an offset, so equal strings have equal names. Of the first ``span`` grams of a window the one whose name is least
(leftmost of equals) is the window's pointer. Which one that is depends on the window's content alone: two equal windows
have their pointers at the same place, so equal windows can only be found among pointers with the same gram, and about
one position in span / 2 has to be looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .vectors import BLOCK, mixed

_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)
#: Bits of a packed place: position, windows before the pointer, windows owned.
SPAN_BITS = 10


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two strings, one at an offset from the other."""
    x = a * _A + b * _B
    x ^= x >> np.uint64(29)
    return x


def names(units: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, the names of the strings of that many units that start at each position (ascending lengths)."""
    out, held, size = [], units, 1
    for length in lengths:
        while size * 2 <= length:
            held = combined(held[: max(0, len(held) - size)], held[size:])
            size *= 2
        rest = length - size
        n = max(0, len(units) - length + 1)
        out.append(held[:n] if not rest else combined(held[:n], held[rest : rest + n]))
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = max(0, len(x) - width + 1)
    while size * 2 <= width:
        x = np.minimum(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def chunks(total: int, window: int, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches that overlap so that each window start below ``total`` lies whole in exactly one."""
    for first in range(0, max(0, total - window + 1), block):
        yield first, min(total, first + block + window - 1)


def owned(units: np.ndarray, sizes: np.ndarray, window: int, lengths: tuple[int, ...], span: int):
    """Arrays, one entry for each pointer: document, position in it, windows before it, windows owned, and names.

    ``units`` holds the documents end to end, ``sizes`` units each. The names are those of the strings of ``lengths`` units
    (ascending, the gram first, all inside each owned window) that start at the pointer, and of the whole string that the
    owned windows cover, with the pointer's place in it. No window spans two documents.
    """
    if span >= 1 << SPAN_BITS or span + lengths[-1] - 1 > window:
        raise ValueError(f"a window of {window} units has no room for {span} pointers of {lengths[-1]}")
    ends = np.cumsum(sizes)
    parts = []
    for first, end in chunks(len(units), window):
        piece = units[first:end]
        *held, w = names(piece, *lengths, window)
        doc = np.searchsorted(ends, np.arange(first, first + len(w)), side="right")
        s = np.flatnonzero(np.arange(first, first + len(w)) + window <= ends[np.minimum(doc, len(ends) - 1)]) if len(ends) else np.zeros(0, int)
        if not len(s):
            continue
        key = (mixed(held[0]) & ~_LOW) | np.arange(len(held[0]), dtype=np.uint64)
        own = (sliding_least(key, span)[s] & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        lo, hi, p = s[cut], s[np.r_[cut[1:], len(s)] - 1], own[cut]
        left, count = p - lo, hi - lo + 1
        run = combined(combined(w[lo], w[hi]), (left << 20 | count).astype(np.uint64))
        d = doc[lo]
        parts.append((d, p + first - (ends - sizes)[d], left, count, *(h[p] for h in held), run))
    if not parts:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * (len(lengths) + 1)
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def packed(pos: np.ndarray, left: np.ndarray, count: np.ndarray) -> np.ndarray:
    return pos << (2 * SPAN_BITS) | left << SPAN_BITS | count


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << SPAN_BITS) - 1
    return place >> (2 * SPAN_BITS), place >> SPAN_BITS & mask, place & mask
