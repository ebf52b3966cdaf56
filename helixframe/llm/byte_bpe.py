"""Byte-level BPE ids of whole text batches through the tokenizers library.

The merges of a byte-level BPE never cross the pieces that its splitting
pattern makes, so a text's ids are those of its pieces end to end. Pieces are
found with numpy over code points, told apart by a 64-bit hash, and only pieces
not met before go to the library; a text that the numpy splitter can't be sure
about goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from helixframe.llm.shared import U64, Rolling, flat, mix


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies show each byte as: itself if it prints, else 256 and on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = np.array([ord(byte_chars()[b]) for b in range(256)], "<u2")

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)


@lru_cache(1)
def classes() -> np.ndarray:
    """The splitting pattern's class of each code point of the basic plane.

    Code points that Unicode versions may class differently, or that the
    pattern's engines treat in their own way, are UNSURE.
    """
    out = np.full(0x10000, UNSURE, np.uint8)
    for c in range(0x2000):
        cat = unicodedata.category(chr(c))
        if cat[0] == "L":
            out[c] = LETTER
        elif cat[0] == "N":
            out[c] = NUMBER
        elif cat in ("Zs", "Zl", "Zp") or c in (9, 10, 11, 12, 13, 0x85):
            out[c] = SPACE
        elif cat[0] in "PSM" or c < 0x20 or c == 0x7F:
            out[c] = OTHER
    out[0x1C:0x20] = UNSURE
    out[0x370:] = UNSURE
    for c in range(0x2010, 0x2028):
        out[c] = OTHER
    out[0x20AC] = OTHER
    return out


def code_points(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins; those past the basic plane become 0xFFFF."""
    begin = np.flatnonzero((body & 0xC0) != 0x80)
    if len(begin) == len(body):
        return body.astype(np.uint16), begin
    lead = body[begin].astype(np.uint32)
    cp = lead.copy()
    pad = np.r_[body, np.zeros(3, np.uint8)]
    two = np.flatnonzero((lead >= 0xC0) & (lead < 0xE0))
    at = begin[two]
    cp[two] = (lead[two] & 0x1F) << 6 | (pad[at + 1] & 0x3F)
    three = np.flatnonzero((lead >= 0xE0) & (lead < 0xF0))
    at = begin[three]
    cp[three] = (lead[three] & 0x0F) << 12 | (pad[at + 1].astype(np.uint32) & 0x3F) << 6 | (pad[at + 2] & 0x3F)
    cp[lead >= 0xF0] = 0xFFFF
    return cp.astype(np.uint16), begin


def pieces(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pieces (with a last bound), and which rows are unsure."""
    if not len(body):
        return np.zeros(1, np.int64), np.zeros(len(offsets) - 1, bool)
    cp, begin = code_points(body)
    kind = classes()[cp]
    n = len(cp)
    row_first = np.searchsorted(begin, offsets[:-1][np.diff(offsets) > 0])
    new_row = np.zeros(n + 1, bool)
    new_row[row_first] = True
    new_row[n] = True
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut |= new_row[:n]
    # A run of white space: all but its last stays one piece when text follows; the last is a piece
    # of its own, and if it is a blank, it joins what follows.
    space = kind == SPACE
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:] & ~new_row[1:n]
    last = space & next_solid
    cut |= last
    blank = last & (cp == 32)
    after = np.flatnonzero(blank) + 1
    cut[after] = False
    # Contractions begin a piece at an apostrophe that itself begins one (no blank before it).
    apos = np.flatnonzero((cp == 39) & cut)
    odd = np.zeros(0, np.int64)
    if len(apos):
        pad = np.r_[cp, np.zeros(2, np.uint16)]
        one = np.isin(pad[apos + 1], [ord(c) for c in "stmd"])
        two = np.isin(pad[apos + 1].astype(np.int32) << 8 | pad[apos + 2], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        odd = apos[one | two]
    unsure_at = np.concatenate([np.flatnonzero(kind == UNSURE), odd])
    unsure = np.zeros(len(offsets) - 1, bool)
    unsure[np.searchsorted(offsets, begin[unsure_at], "right") - 1] = True
    return np.r_[begin[cut], len(body)], unsure


class Encoder:
    """Ids of text batches; remembers pieces up to ``most`` of them, then starts anew."""

    def __init__(self, path: str, most: int = 1 << 20):
        self.tok, self.most = load(path), most
        specials = self.tok.get_added_tokens_decoder().values()
        self.special = [str(s.content).encode() for s in specials]
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.begin, self.size, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Pieces go to the library's merge model itself, which spares its text bookkeeping."""
        merge = self.tok.model.tokenize
        ids = [[t.id for t in merge(w)] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat_ids = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        self.begin = np.r_[self.begin, len(self.pool) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.pool = np.r_[self.pool, flat_ids]
        slots = np.arange(len(self.slots), len(self.slots) + len(keys))
        keys = np.r_[self.keys, keys]
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], np.r_[self.slots, slots][order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, bounds of each row); null is empty."""
        body, offsets = flat(column)
        bounds, unsure = pieces(body, offsets)
        raw = body.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                unsure[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        start, end = bounds[:-1], bounds[1:]
        row = np.searchsorted(offsets, start, "right") - 1
        roll = Rolling(Rolling.LUT[body])
        key = roll.of(start, end) ^ mix((end - start).astype(U64))
        which, keys = pd.factorize(key)
        first = np.zeros(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(key) - 1, -1, -1)
        if len(self.keys) > self.most:
            self.reset()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            # Pieces of unsure rows may be cut wrongly; they are learnt like others but never used.
            shown = BYTE_CHARS[body].tobytes().decode("utf-16-le")
            self._learn(keys[new], [shown[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][which] if len(keys) else np.zeros(0, np.int64)
        size = self.size[slot]
        ids = self.pool[np.repeat(self.begin[slot], size) + within(size)]
        counts = np.bincount(row, size, len(offsets) - 1).astype(np.int64)
        if unsure.any():
            rows = np.flatnonzero(unsure)
            cut = np.r_[0, np.cumsum(counts)]
            whole = self.tok.encode_batch([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in rows], add_special_tokens=False)
            parts, last = [], 0
            for i, e in zip(rows, whole, strict=True):
                parts += [ids[cut[last] : cut[i]], np.array(e.ids, np.uint32)]
                counts[i], last = len(e.ids), i + 1
            ids = np.concatenate([*parts, ids[cut[last] :]])
        return ids, np.r_[0, np.cumsum(counts)]


def within(size: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, end to end."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size)
