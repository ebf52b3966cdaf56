"""First words of MD5 for many short texts at once, for the batch side of ``rng``."""

from __future__ import annotations

import hashlib

import numpy as np

U32 = np.uint32
#: Texts hashed together: the state then stays in a core's cache.
TOGETHER = 1 << 14
# Fixed values of MD5 (RFC 1321).
_START = tuple(map(U32, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))
_TURN = [t[i % 4] for t in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_ADD = [U32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]


def _state(head: np.ndarray, tail: np.ndarray) -> list[np.ndarray]:
    """The four words after one block, whose 16 words are those of ``head`` and of ``tail``; the two broadcast."""
    m = [h if not t.any() else t if not h.any() else h | t for h, t in zip(head, tail, strict=True)]
    shape = np.broadcast_shapes(head.shape[1:], tail.shape[1:])
    a, b, c, d = (np.full(shape, v, U32) for v in _START)
    f = np.empty(shape, U32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += m[_WORD[i]] + _ADD[i]
        np.left_shift(a, U32(_TURN[i]), out=f)
        a >>= U32(32 - _TURN[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [x + v for x, v in zip((a, b, c, d), _START, strict=True)]


def _heads(texts: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(texts), 64), np.uint8)
    out[:, :size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return out.view("<u4").T.astype(U32)


def _tails(texts: list[bytes], at: int) -> np.ndarray:
    out = np.zeros((len(texts), 64), np.uint8)
    for i, t in enumerate(texts):
        out[i, at : at + len(t)] = np.frombuffer(t, np.uint8)
        out[i, at + len(t)] = 0x80
        out[i, 56:58] = np.frombuffer((8 * (at + len(t))).to_bytes(2, "little"), np.uint8)
    return out.view("<u4").T.astype(U32)


def _groups(heads: list[bytes], tails: list[bytes]):
    """(size, row numbers) of the heads of each size; size -1 for those that don't fit a block."""
    size, longest = np.array([len(h) for h in heads], np.int64), max(map(len, tails), default=0)
    size = np.where(size + longest > 55, -1, size)
    for s in np.unique(size).tolist():
        yield s, np.flatnonzero(size == s)


def _plain(text: bytes, words: int) -> np.ndarray:
    return np.frombuffer(hashlib.md5(text).digest(), ">u4")[:words]


def every(heads: list[bytes], tails: list[bytes], words: int = 1) -> np.ndarray:
    """(heads, tails, words): the first 32-bit words of md5(head + tail)."""
    out = np.zeros((len(heads), len(tails), words), U32)
    step = max(1, TOGETHER // max(len(tails), 1))
    for size, rows in _groups(heads, tails):
        if size < 0:
            for r in rows.tolist():
                out[r] = [_plain(heads[r] + t, words) for t in tails]
            continue
        tail = _tails(tails, size)[:, None, :]
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            state = _state(_heads([heads[r] for r in part.tolist()], size)[:, :, None], tail)
            for w in range(words):
                out[part, :, w] = state[w].byteswap()
    return out


def some(heads: list[bytes], tails: list[bytes], row: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The first word of md5(heads[row] + tails[which]) of each pair."""
    out, place = np.zeros(len(row), U32), np.zeros(len(heads), np.int64)
    if not len(row):
        return out
    for size, rows in _groups(heads, tails):
        mine = np.zeros(len(heads), bool)
        mine[rows] = True
        at = np.flatnonzero(mine[row])
        if size < 0:
            out[at] = [_plain(heads[r] + tails[t], 1)[0] for r, t in zip(row[at].tolist(), which[at].tolist(), strict=True)]
            continue
        head, tail = _heads([heads[r] for r in rows.tolist()], size), _tails(tails, size)
        place[rows] = np.arange(len(rows))
        for k in range(0, len(at), TOGETHER):
            part = at[k : k + TOGETHER]
            out[part] = _state(head[:, place[row[part]]], tail[:, which[part]])[0].byteswap()
    return out
