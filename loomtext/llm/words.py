"""Words of UTF-8 texts as numpy arrays: where they start and end, and a 64-bit hash of each.

A block of texts is handled as one byte buffer, so the cost of Python is paid once a block and not once a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are gathered into blocks of about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 19

#: Hashes are polynomials modulo this prime. Modulo a power of two they would not do: whatever the base, strings that follow the
#: Thue-Morse sequence and its complement would meet.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x1E3779B97F4A7C15 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Elements that are worked on at a time, so that all that stands between stays in a core's cache.
_STRIDE = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo PRIME; a difference that wraps around is the larger one."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below 2 * PRIME and below PRIME, from halves of 31 bits."""
    low, u31, u30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30)
    xh, xl, yh, yl = a >> u31, a & low, b >> u31, b & low
    middle = xl * yh
    middle += xh * yl
    xh *= yh
    xl *= yl
    xh += xh
    xh += xl
    xh += middle >> u30
    middle &= np.uint64((1 << 30) - 1)
    middle <<= u31
    xh += middle
    return _reduced(xh)


#: Bytes stand for themselves and one, so that a zero byte counts.
_BYTE_VALUE = np.arange(1, 257, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, size = np.ones(1, dtype=np.uint64), max(n, 2 * BLOCK_BYTES)
        while len(have) < size:
            have = np.concatenate((have, times(have, np.full(len(have), pow(base, len(have), PRIME), dtype=np.uint64))))
        if size <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo PRIME over bytes; ``span_hashes`` reads the hash of any span from them."""
    return prefix_sums(_BYTE_VALUE[data])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """The same over symbols of any kind, given by 64-bit values."""
    n, power = len(values), _power(_BASE, len(values))
    out, last = np.zeros(n + 1, dtype=np.uint64), np.uint64(0)
    small, u30 = n and int(values.max()) < 1 << 10, np.uint64(30)
    low = np.uint64((1 << 30) - 1)
    for i in range(0, n, _STRIDE):
        v, y = values[i : i + _STRIDE], power[i : i + _STRIDE]
        if small:  # halves of the powers: sums of a stride's products stay below 2**55
            high, each = np.cumsum(v * (y >> u30)), np.cumsum(v * (y & low))
        else:
            each = times(_reduced(v), y)
            high, each = np.cumsum(each >> u30), np.cumsum(each & low)
        # high * 2**30 modulo PRIME turns its bits round
        each += (high & np.uint64((1 << 31) - 1)) << u30
        each += high >> np.uint64(31)
        each += last
        out[i + 1 : i + 1 + len(v)] = each = _reduced(each)
        last = each[-1]
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each span; equal bytes give equal hashes wherever they stand."""
    out, inverse = np.empty(len(start), dtype=np.uint64), _power(_INVERSE, len(prefix))
    for i in range(0, len(start), _STRIDE):
        s, e = start[i : i + _STRIDE], end[i : i + _STRIDE]
        h = prefix[e]
        h += _P
        h -= prefix[s]
        h = times(h, inverse[s])
        h += (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out[i : i + _STRIDE] = mixed(h)
    return out


def table_of(word_bytes) -> np.ndarray:
    """A table over byte values: True for those that stand in words."""
    out = np.zeros(256, dtype=bool)
    out[list(word_bytes)] = True
    return out


#: [^\x20\x09-\x0D]+ : all but ASCII white space.
NOT_SPACE = table_of(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters in either case and all beyond ASCII.
ALNUM = table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Block:
    """Some texts in one buffer, a space after each; text ``i`` is ``data[begin[i]:finish[i]]``."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, finish: np.ndarray, first: int):
        self.data, self.begin, self.finish, self.first = data, begin, finish, first

    def __len__(self) -> int:
        return len(self.begin)

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of the text it stands in."""
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = table[self.data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return start, end, np.searchsorted(self.finish, start, side="right")


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Splits a column of strings into blocks. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1)
        to = min(to, n)
        cut = offsets[at : to + 1] - offsets[at]
        data = np.insert(raw[offsets[at] : offsets[to]], cut[1:], 0x20)
        shift = np.arange(to - at)
        yield Block(data, cut[:-1] + shift, cut[1:] + shift, at)
        at = to


def starts_by_text(owner: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's items in an array sorted by text: items of text i are [out[i], out[i + 1])."""
    return np.searchsorted(owner, np.arange(n + 1))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] numbers, then the same for the others, end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first - start, count)
