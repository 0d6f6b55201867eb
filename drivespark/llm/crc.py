"""CRC-32 of joined byte strings from the CRCs of their parts, many at a time.

The CRC is linear over GF(2) but for its constants: with ``shift(c, k)`` the product of ``c`` and the matrix that appends k
zero bytes, ``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``. The matrix of k bytes is a product of those of its powers of
two; each of these is held as four tables of 256 entries (a row of the product for every value of each byte), which are
made from the polynomial when they are first needed.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: The reflected polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320
SPACE = zlib.crc32(b" ")


def _tables(columns: list[int]) -> np.ndarray:
    """The matrix with these images of the 32 unit vectors, as four tables by byte."""
    out = np.zeros((4, 256), np.uint32)
    for bit, image in enumerate(columns):
        rows = np.arange(256) >> (bit % 8) & 1 == 1
        out[bit // 8, rows] ^= np.uint32(image)
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return tables[0, x & byte] ^ tables[1, x >> np.uint32(8) & byte] ^ tables[2, x >> np.uint32(16) & byte] ^ tables[3, x >> np.uint32(24)]


@cache
def power(k: int) -> np.ndarray:
    """Tables of the matrix that appends 2**k zero bytes."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k:
        images = _times(power(k - 1), _times(power(k - 1), units))
    else:
        images = units
        for _ in range(8):
            images = images >> np.uint32(1) ^ np.where(images & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return _tables(images.tolist())


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says."""
    out, left = crcs.astype(np.uint32), np.asarray(lengths, np.int64)
    for k in range(int(left.max(initial=0)).bit_length()):
        at = np.flatnonzero(left >> k & 1)
        out[at] = _times(power(k), out[at])
    return out


def joined(a: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """CRCs of strings a + b, from those of a and b and the bytes that b has."""
    return shift(a, b_lengths) ^ b
