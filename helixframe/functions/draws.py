"""Many draws to a row in numpy: a key from MD5, then splitmix64 over the row and the draw's number."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U64 = np.uint64
_STEP, _ONE, _TWO = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def key(seed: int, stream: str, *keys: int) -> int:
    """The first 64 bits of md5(seed:stream:key:...)."""
    return int.from_bytes(hashlib.md5(":".join(map(str, (seed, stream, *keys))).encode()).digest()[:8], "big")


def mixed(x: np.ndarray) -> np.ndarray:
    """The output function of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= _ONE
    x ^= x >> U64(27)
    x *= _TWO
    x ^= x >> U64(31)
    return x


def stems(key: int, *names: np.ndarray) -> np.ndarray:
    """Where the draws of each row begin, from the whole numbers that name it."""
    out = np.full(1, key, U64)
    for x in names:
        out = mixed(out + (x.astype(np.int64).view(U64) + U64(1)) * _STEP)
    return out


def words(stems: np.ndarray, first: int, many: int) -> np.ndarray:
    """(stems, many): the 64-bit draws from number ``first`` on."""
    return mixed(stems[:, None] + np.arange(first + 1, first + many + 1, dtype=U64) * _STEP)


@lru_cache(64)
def _passed(rate: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of 32-bit draws between numbers of passed positions, rising; and that number by a draw's upper 16 bits, -1 where they don't tell."""
    edges = np.floor(np.cumprod(np.full(length, 1.0 - rate)) * 2.0**32).astype(np.int64)[::-1]
    low = np.arange(1 << 16, dtype=np.int64) << 16
    most, least = (length - np.searchsorted(edges, x, "right") for x in (low, low + 0xFFFF))
    return edges, np.where(most == least, most, -1).astype(np.int32)


def gaps(draw: np.ndarray, rate: float, length: int) -> np.ndarray:
    """How many positions each 32-bit draw passes over, ``length`` for that many or more: g or more with probability (1 - rate)^g."""
    edges, table = _passed(rate, length)
    out = table[draw >> U64(16)]
    at = np.flatnonzero(out.reshape(-1) < 0)
    out.reshape(-1)[at] = length - np.searchsorted(edges, draw.reshape(-1)[at].astype(np.int64), "right")
    return out


def redraw(grid: np.ndarray, stems: np.ndarray, rate: float, letters: np.ndarray) -> None:
    """Each place of a row is drawn anew from four ``letters`` with probability ``rate``, in place; the upper half of a draw tells how many places are passed, the last two bits the letter."""
    length = grid.shape[1]
    many = int(rate * length + 2 * (rate * length) ** 0.5) + 4
    rows, at, first = np.arange(len(grid)), np.full(len(grid), -1, np.int32), 0
    flat = grid.reshape(-1)
    while len(rows) and rate > 0:
        word = words(stems[rows], first, many)
        place = gaps(word >> U64(32), rate, length)
        place += 1
        np.cumsum(place, axis=1, out=place)
        place += at[:, None]
        hit = np.flatnonzero(place < length)
        flat[rows[hit // many] * length + place.reshape(-1)[hit]] = letters[(word.reshape(-1)[hit] & U64(3)).astype(np.intp)]
        more = place[:, -1] < length
        rows, at, first = rows[more], place[more, -1], first + many
