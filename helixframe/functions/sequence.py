"""Scalar functions of DNA strings, as column expressions. Codes: A 0, C 1, G 2, T 3."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BASES = "ACGT"

#: Codes of bytes; what is no base counts as A.
_CODES = np.zeros(256, np.uint8)
for _code, _base in enumerate(BASES):
    _CODES[ord(_base)] = _code

# The 15-base adapters either side of a 200-base core.
ADAPTER_5, ADAPTER_3 = "AGGACCGGATCAACT", "CATTGCGTGAACCGA"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------- whole batches in numpy
# What looks at every base of a sequence is done on the bytes of an Arrow batch:
# the same in column expressions makes an array of strings for each row.


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end and each row's bounds; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return body, o - o[0]


def padded(body: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each string, cut or filled up with zeros."""
    size = np.minimum(np.diff(offsets), width)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(size), int(width)), np.uint8)
    out[row, at] = body[offsets[:-1][row] + at]
    return out


def kmer_codes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, base-4 number) of every k-mer of a batch; k-mers never cross rows."""
    body, offsets = _joined(column)
    code, n = _CODES[body].astype(np.int64), max(len(body) - k + 1, 0)
    number = np.zeros(n, np.int64)
    for i in range(k):
        number = number * 4 + code[i : i + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    return row[:n][whole], number[whole]


def kmer_table_sum(seq: Column | str, table: tuple[int, ...], k: int = 3) -> Column:
    """The sum of whole numbers that ``table`` has for a sequence's k-mers; null for a null sequence."""
    return _table_sum(table, k)(_c(seq))


@lru_cache(64)
def _table_sum(table: tuple[int, ...], k: int):
    values = np.array(table, np.int64)

    @F.arrow_udf(LongType())
    def total(column: pa.Array) -> pa.Array:
        row, number = kmer_codes(column, k)
        out = np.zeros(len(column), np.int64)
        np.add.at(out, row, values[number])
        return pa.array(out, mask=column.is_null().to_numpy(zero_copy_only=False))

    return total


@F.arrow_udf(LongType())
def _differing(a: pa.Array, b: pa.Array) -> pa.Array:
    (x, ox), (y, oy) = _joined(a), _joined(b)
    size = np.minimum(np.diff(ox), np.diff(oy))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    differ = x[ox[row] + at] != y[oy[row] + at]
    out = np.bincount(row[differ], minlength=len(size)) + np.abs(np.diff(ox) - np.diff(oy))
    null = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    return pa.array(out, mask=null)


_IS_BASE = np.zeros(256, bool)
_IS_BASE[[ord(b) for b in BASES]] = True


@F.arrow_udf(LongType())
def _longest_run(column: pa.Array) -> pa.Array:
    body, offsets = _joined(column)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(body), bool)
    new[1:] = (body[1:] != body[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, len(body)])
    base = _IS_BASE[body[begin]]
    out = np.zeros(len(column), np.int64)
    np.maximum.at(out, row[begin[base]], size[base])
    return pa.array(out, mask=column.is_null().to_numpy(zero_copy_only=False))


def encode(seq: Column | str) -> Column:
    """Digits 0..3 for ACGT."""
    return F.translate(_c(seq), BASES, "0123")


def decode(digits: Column | str) -> Column:
    return F.translate(_c(digits), "0123", BASES)


def tokens(seq: Column | str) -> Column:
    """Array of codes."""
    return F.transform(F.split(encode(seq), ""), lambda t: t.cast("int"))


def one_hot(seq: Column | str) -> Column:
    """Array of 4-element arrays, channel last."""
    return F.transform(tokens(seq), lambda t: F.array(*[(t == i).cast("int") for i in range(4)]))


def from_one_hot(hot: Column | str) -> Column:
    """Digits of the first largest channel of each position."""
    return F.array_join(F.transform(_c(hot), lambda h: (F.array_position(h, F.array_max(h)) - 1).cast("string")), "")


def cleaned(seq: Column | str, on_invalid: str = "error") -> Column:
    """Upper-case bases; an unknown base raises, becomes A, or makes the row null (``drop``)."""
    up = F.upper(_c(seq))
    bad = up.rlike("[^ACGT]")
    if on_invalid == "as_A":
        return F.regexp_replace(up, "[^ACGT]", "A")
    if on_invalid == "drop":
        return F.when(~bad, up)
    if on_invalid == "error":
        return F.when(bad, F.raise_error(F.concat(F.lit("unknown base in "), up))).otherwise(up)
    raise ValueError(on_invalid)


def count_of(seq: Column | str, bases: str) -> Column:
    rest = "".join(b for b in BASES if b not in bases)
    return F.length(F.translate(_c(seq), rest, "")).cast("long")


def gc(seq: Column | str) -> Column:
    """One division, so that a value at a bound stays at it."""
    return count_of(seq, "CG") / F.length(_c(seq))


def cpg(seq: Column | str) -> Column:
    """CG dinucleotides over L - 1. Occurrences can't overlap, so a replacement counts them."""
    s = _c(seq)
    return ((F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2) / F.nullif(F.length(s) - 1, F.lit(0))


def asymmetry(seq: Column | str, a: str, b: str) -> Column:
    s = _c(seq)
    return F.abs(count_of(s, a) - count_of(s, b)) / F.length(s)


def homopolymer(seq: Column | str) -> Column:
    """The longest run of one base; 0 without a base."""
    return _longest_run(_c(seq))


def entropy(seq: Column | str) -> Column:
    """Bits; 0 log 0 = 0."""
    total = F.lit(0.0)
    for b in BASES:
        f = count_of(seq, b) / F.length(_c(seq))
        total = total + F.when(f > 0, -f * F.log2(f)).otherwise(0.0)
    return total


def _windows(items: Column, length: Column, k: int, join) -> Column:
    """Neighbouring elements joined k at a time; the array is cut k times, never once per element."""
    n = F.greatest(length - (k - 1), F.lit(0))
    out = F.slice(items, F.lit(1), n)
    for i in range(2, k + 1):
        out = F.zip_with(out, F.slice(items, F.lit(i), n), join)
    return out


def kmers(seq: Column | str, k: int = 3) -> Column:
    s = _c(seq)
    return _windows(F.split(s, ""), F.length(s), k, lambda a, b: F.concat(a, b))


def kmer_indices(seq: Column | str, k: int = 3) -> Column:
    """Base-4 numbers of all k-mers."""
    return _windows(tokens(seq), F.length(_c(seq)), k, lambda a, b: a * 4 + b)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def strip_adapters(seq: Column | str, core: int = 200) -> Column:
    return F.substring(_c(seq), len(ADAPTER_5) + 1, core)


def inject_adapters(core: Column | str) -> Column:
    return F.concat(F.lit(ADAPTER_5), _c(core), F.lit(ADAPTER_3))


def construct(core: Column | str, promoter: str, barcode: str) -> Column:
    """Adapter, core, adapter, promoter, barcode."""
    return F.concat(inject_adapters(core), F.lit(promoter), F.lit(barcode))


def roll(seq: Column | str, by: int) -> Column:
    """Circular shift to the right."""
    s = _c(seq)
    return F.concat(F.right(s, F.pmod(F.lit(by), F.length(s))), F.left(s, F.length(s) - F.pmod(F.lit(by), F.length(s))))


def splice_shift(seq: Column | str, by: int, left: str, right: str) -> Column:
    """Shift with the flanks moving in; the length stays."""
    s = _c(seq)
    if by >= 0:
        return F.concat(F.lit(left[len(left) - by :]), F.left(s, F.length(s) - by))
    return F.concat(F.right(s, F.length(s) + by), F.lit(right[:-by]))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing positions of two strings of ASCII letters; what one is longer counts as differing."""
    return _differing(_c(a), _c(b))


def motif_count(seq: Column | str, motif: str) -> Column:
    """Overlapping occurrences."""
    return F.regexp_count(_c(seq), F.lit(f"(?={motif})")).cast("long")


def orientation(seq: Column | str) -> Column:
    """forward, reverse, or null where neither adapter leads."""
    s = _c(seq)
    lead = F.left(s, F.lit(len(ADAPTER_5)))
    back = ADAPTER_3.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return F.when(lead == ADAPTER_5, "forward").when(F.left(s, F.lit(len(back))) == back, "reverse")


def prefix_tokens(label: Column | str, seq: Column | str, offset: int = 7) -> Column:
    """Label digits, then base codes, both moved by ``offset`` into the model's token space."""
    digits = F.transform(F.split(_c(label), ""), lambda t: t.cast("int") + offset)
    return F.concat(digits, F.transform(tokens(seq), lambda t: t + offset))


def logit_mask(vocabulary: int, offset: int = 7, allowed: str = BASES) -> Column:
    """0 for the tokens of ``allowed`` bases in a model's token space, minus infinity for all others."""
    codes = [BASES.index(b) + offset for b in allowed]
    return F.transform(F.sequence(F.lit(0), F.lit(vocabulary - 1)), lambda i: F.when(i.isin(codes), 0.0).otherwise(float("-inf")))
