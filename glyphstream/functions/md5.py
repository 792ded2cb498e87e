"""MD5 of many short messages at once, as array operations."""

from __future__ import annotations

import math

TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDENDS = tuple(int(abs(math.sin(k + 1)) * (1 << 32)) for k in range(64))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that a message of one block holds.
MOST = 55


def numbered(keys: list[bytes], numbers: range):
    """For each number c of numbers: the digests of b"c:key" of all keys, as the four little-endian words, each an array of uint32.

    Keys with their number and colon have MOST bytes at most, numbers three digits. What the number leaves as it is, is laid out once for each number of digits.
    """
    import numpy as np

    n = len(keys)
    size = np.array([len(k) for k in keys], np.int64)
    raw = np.frombuffer(b"".join(keys), np.uint8)
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    f, t, u = (np.empty(n, np.uint32) for _ in range(3))
    digits, added = 0, []
    for c in numbers:
        head = b"%d:" % c
        if len(head) != digits:
            digits = len(head)
            block = np.zeros((n, 64), np.uint8)
            block[row, col + digits] = raw
            block[np.arange(n), size + digits] = 0x80
            block[:, 56:58] = ((size + digits) * 8).astype("<u2").view(np.uint8).reshape(n, 2)
            words = np.ascontiguousarray(block.view("<u4").T)
            first = words[0].copy()
            # words that are zero in all messages need no array
            used = [bool(w.any()) for w in words]
            added = [(words[g] + np.uint32(ADDENDS[k])) if g and used[g] else np.uint32(ADDENDS[k]) for k in range(64) for g in [_word(k)]]
        np.bitwise_or(first, np.uint32(int.from_bytes(head, "little")), out=words[0])
        a, b, cc, d = (np.full(n, x, np.uint32) for x in START)
        for k in range(64):
            if k < 16:  # d ^ (b & (c ^ d))
                np.bitwise_xor(cc, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif k < 32:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, cc, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, cc, out=f)
            elif k < 48:
                np.bitwise_xor(b, cc, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, cc, out=f)
            np.add(f, a, out=f)
            np.add(f, added[k], out=f)
            if not _word(k):
                np.add(f, words[0], out=f)
            turn = TURNS[k // 16][k % 4]
            np.left_shift(f, np.uint32(turn), out=t)
            np.right_shift(f, np.uint32(32 - turn), out=u)
            np.bitwise_or(t, u, out=t)
            np.add(t, b, out=a)
            a, b, cc, d = d, a, b, cc
        yield c, [x + np.uint32(s) for x, s in zip((a, b, cc, d), START)]


def _word(k: int) -> int:
    """The message word that step k adds."""
    return (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16
