"""CRC-32 as linear algebra over GF(2): checksums of joined strings from those of their parts.

The register of a CRC is linear in what was fed to it, so crc(a + b) = S(len b) crc(a) xor crc(b), where S(n) is the
32 x 32 bit matrix that feeds n zero bytes. S(n) is the product of the matrices of the powers of two in n; each is
kept as four tables of 256 columns, so that a whole array of checksums is shifted by four lookups.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Fixed value: the reflected polynomial of the usual CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words up to so many bytes are read a byte at a time, all at once; longer ones one by one.
STEPPED_BYTES = 48


@functools.cache
def byte_table() -> np.ndarray:
    """What the register's low byte turns into as one byte passes."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@functools.cache
def shift_by_power(k: int) -> np.ndarray:
    """The matrix of 2**k zero bytes, as tables [4, 256]."""
    low = np.arange(256, dtype=np.uint32)
    each = np.stack([low << np.uint32(8 * i) for i in range(4)])
    if k == 0:
        return byte_table()[each & np.uint32(255)] ^ (each >> np.uint32(8))
    half = shift_by_power(k - 1)
    return _apply(half, _apply(half, each.ravel())).reshape(4, 256)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each checksum moved on by so many zero bytes."""
    out = crc.astype(np.uint32, copy=True)
    for k in range(int(length.max(initial=0)).bit_length()):
        has = (length >> k) & 1 == 1
        if has.all():
            out = _apply(shift_by_power(k), out)
        elif has.any():
            out[has] = _apply(shift_by_power(k), out[has])
    return out


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc(a + b) from crc(a), crc(b) and the bytes of b."""
    return shifted(first, length) ^ second


def of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start[i]:end[i]]."""
    table, length = byte_table(), end - start
    out = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for i in np.flatnonzero(length > STEPPED_BYTES):
        out[i] = np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes()) ^ 0xFFFFFFFF)
    order = np.argsort(np.minimum(length, STEPPED_BYTES + 1), kind="stable")
    order = order[: np.searchsorted(length[order], STEPPED_BYTES, side="right")] if (length > STEPPED_BYTES).any() else order
    lengths, at, register = length[order], start[order], out[order]
    for step in range(int(lengths.max(initial=0))):
        first = np.searchsorted(lengths, step, side="right")  # those that have a byte left
        r = register[first:]
        register[first:] = table[(r ^ data[at[first:] + step]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[order] = register
    return out ^ np.uint32(0xFFFFFFFF)
