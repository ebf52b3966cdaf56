"""A hash PRNG: the same numbers for any partitioning, in Spark and in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(seed: int, stream: str, keys: tuple[Column | str, ...]) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *(F.col(k) if isinstance(k, str) else k for k in keys))


def stem(seed: int, stream: str, *keys: Column | str) -> Column:
    """All of a draw's text but its last key: ``digests`` of ``heads`` and ``tails`` are the draws of ``uniform``, a batch at once."""
    return F.concat(_text(seed, stream, keys), F.lit(":"))


def heads(stems: pa.Array) -> list[bytes]:
    return [x.encode() for x in stems.to_pylist()]


def tails(n: int) -> list[bytes]:
    """The last keys 0 to n - 1."""
    return [str(i).encode() for i in range(n)]


def uniform(seed: int, stream: str, *keys: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of md5(seed:stream:key:...)."""
    return F.conv(F.substring(F.md5(_text(seed, stream, keys)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def order_key(seed: int, *keys: Column | str) -> Column:
    """A string to order rows by at random: md5(seed:key:...)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k) if isinstance(k, str) else k for k in keys)))
