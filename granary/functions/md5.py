"""MD5 of many short texts at once, by numpy: each pair of a head and a name is a text, as long as one block of the hash takes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fit in one block, and pairs that are hashed at a time, so that they stay in a core's cache.
ONE_BLOCK, AT_ONCE = 55, 16_384


def _words(texts: Sequence[bytes], at: int) -> np.ndarray:
    """(text, 16): texts of one length laid at a byte of an empty block, as its little-endian words."""
    block = np.zeros((len(texts), 64), np.uint8)
    if texts and texts[0]:
        block[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return block.view("<u4").astype(np.uint32)


def _hash(words: list, shape: tuple[int, int]) -> np.ndarray:
    """(4, rows, columns): words of the hash; those of the block are arrays, or numbers where all texts have the same."""
    a, b, c, d = (np.full(shape, s, np.uint32) for s in START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for k in range(64):
        if k < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            j = k
        elif k < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            j = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            j = (3 * k + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            j = 7 * k % 16
        w, s = words[j], SHIFTS[k // 16][k % 4]
        f += a
        if isinstance(w, np.ndarray):
            f += w
            f += np.uint32(SINES[k])
        else:
            f += np.uint32((SINES[k] + w) % 2**32)
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), START, strict=True)])


def md5_words(heads: Sequence[bytes], names: Sequence[bytes]) -> np.ndarray:
    """(4, name, head): the four words of md5(head + name), each of eight of its hexadecimal digits in their order."""
    out = np.empty((4, len(names), len(heads)), np.uint32)
    by = lambda texts: {n: np.flatnonzero(np.fromiter(map(len, texts), int, len(texts)) == n) for n in set(map(len, texts))}
    for n, rows in by(names).items():
        for m, columns in by(heads).items():
            if m + n > ONE_BLOCK:
                for r in rows:
                    for c in columns:
                        out[:, r, c] = np.frombuffer(hashlib.md5(heads[c] + names[r]).digest(), ">u4")
                continue
            head, end = _words([heads[c] for c in columns], 0), _words([b"\x80"], m + n)[0]
            end[14] = 8 * (m + n)
            step = max(1, AT_ONCE // len(columns))
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                name = _words([names[r] for r in own], m)
                # bytes of head, name and end don't overlap; words that only hold the end are one number
                words = [head[None, :, j] | name[:, None, j] | end[j] if 4 * j < m + n else int(end[j]) for j in range(16)]
                out[:, own[:, None], columns] = _hash(words, (len(own), len(columns))).byteswap()
    return out
