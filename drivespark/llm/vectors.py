"""Numpy helpers on UTF-8 bytes: texts of a batch end to end, runs of word bytes, hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; memory is a small multiple of it, however long a batch or a text is.
BLOCK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: A random 64-bit value for each byte, by a fixed seed, so that all workers agree.
BYTE_VALUE = np.random.default_rng(20_240_229).integers(1, 2**64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def byte_column(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``block`` bytes together; one long text may be over it alone."""
    return groups_of([len(t) for t in texts], block)


def groups_of(sizes: list[int], block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """``groups`` of texts of so many bytes."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > block:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word buf[start:end]; words must not be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(lens.sum()) - np.repeat(first, lens)
    power = np.full(int(lens.max()), _MULTIPLIER)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = BYTE_VALUE[buf[np.repeat(starts, lens) + within]] * power[within]
    return mixed(np.add.reduceat(value, first) + lens.astype(np.uint64))


def held_out(crc_of, parts: int, rest: int):
    """Column: whether crc32 of the id as text leaves ``rest`` (a null id counts as the empty text)."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(crc_of.cast("string"), F.lit("")).cast("binary")) % parts == rest
