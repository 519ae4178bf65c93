"""The first 32 bits of MD5 of many short texts at once, in numpy: hashlib takes a call, an object and a digest for each."""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

# fixed values of the algorithm: shifts by round, sines, the state before the first block
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at once; bytes that fit one block beside the mark of the end and the length.
AT_ONCE, FITS = 16_384, 55


def _first(words: np.ndarray) -> np.ndarray:
    """Of each column, the 16 words of a text's one block, the first 32 bits of its digest."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in STATE)
    f, t = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        part, at = k // 16, (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16
        if part == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif part == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif part == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += words[at]
        a += np.uint32(SINES[k])
        by = SHIFTS[part][k % 4]
        np.right_shift(a, np.uint32(32 - by), out=t)
        a <<= np.uint32(by)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(STATE[0])).byteswap()


def heads(before: list[str], cuts: list[int], names: list[bytes]) -> np.ndarray:
    """The first 32 bits of the MD5 of each name after its group's prefix, as numbers; group k holds the names from cuts[k] to cuts[k + 1]. Names hold no zero bytes."""
    made = np.empty(len(names), np.int64)
    prefixes = [u.encode() for u in before]
    of = np.repeat(np.arange(len(before)), np.diff(cuts))
    each = np.array(names, "S") if any(names) else np.zeros(len(names), "S1")
    wide, sizes = each.dtype.itemsize, np.char.str_len(each)
    lengths = np.array([len(p) for p in prefixes], np.int64)
    heldable = np.array([p[: FITS + 9].ljust(FITS + 9, b"\0") for p in prefixes], f"S{FITS + 9}")
    starts, ends = np.frombuffer(heldable.tobytes(), np.uint8).reshape(len(prefixes), FITS + 9), np.frombuffer(each.tobytes(), np.uint8).reshape(len(names), wide)
    short = lengths[of] + wide <= FITS
    for first in range(0, len(names), AT_ONCE):
        some = first + np.flatnonzero(short[first : first + AT_ONCE])
        if len(some):
            block, length, row = starts[of[some]], lengths[of[some]], np.arange(len(some))
            for k in range(wide):
                block[row, length + k] = ends[some, k]
            length = length + sizes[some]
            block[row, length] = 0x80
            words = block.view("<u4")
            words[:, 14] = 8 * length
            made[some] = _first(np.ascontiguousarray(words.T))
    for k in np.flatnonzero(~short).tolist():
        made[k] = int.from_bytes(md5(prefixes[of[k]] + names[k]).digest()[:4], "big")
    return made
