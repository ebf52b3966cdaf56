"""Mutagenesis by deltas, for scorers that add up values of short windows.

A substitution changes only the windows over it. So the gains of all 3 L
substitutions of a row come from k sums over the row's windows, for a whole
Arrow batch at once, and a greedy walk of any length stays in its row: no
candidate strings, no shuffle, no checkpoint between rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from helixframe.functions import sequence as S

#: Candidates looked at together: rows of a batch times places times four bases.
CELLS = 1 << 22
#: As many of a block of one length, which is gone through several times.
BLOCK = 1 << 19

STEP = StructType([StructField("position", IntegerType()), StructField("base", StringType()), StructField("candidate", StringType()), StructField("candidate_score", DoubleType())])


@dataclass(frozen=True)
class WindowScorer:
    """``scale`` times the sum of whole numbers that the tables have for a sequence's windows.

    ``tables``: for each window size k, 4^k values by the window's base-4
    number (what is no base counts as A). A scorer as a column, too: call it.
    """

    tables: tuple[tuple[int, tuple[int, ...]], ...]
    scale: float = 1.0

    @staticmethod
    def of_motifs(weights: dict[str, int], scale: float = 1.0) -> WindowScorer:
        """Overlapping occurrences of each motif, times its weight."""
        out: dict[int, list[int]] = {}
        for motif, w in weights.items():
            table = out.setdefault(len(motif), [0] * 4 ** len(motif))
            table[sum(S.BASES.index(b) * 4 ** (len(motif) - 1 - i) for i, b in enumerate(motif))] += w
        return WindowScorer(tuple((k, tuple(t)) for k, t in sorted(out.items())), scale)

    def __call__(self, seq: Column | str) -> Column:
        return sum((S.kmer_table_sum(seq, t, k) for k, t in self.tables), F.lit(0)) * F.lit(float(self.scale))

    def totals(self, codes: np.ndarray) -> np.ndarray:
        """The unscaled score of each row of a matrix of codes."""
        out = np.zeros(len(codes), np.int64)
        for k, table in self.tables:
            if codes.shape[1] >= k:
                out += np.array(table, np.int64)[_windows(codes, k)].sum(1)
        return out

    def gains(self, codes: np.ndarray) -> np.ndarray:
        """(rows, places, 4): what the unscaled score gains if a place gets a base."""
        rows, length = codes.shape
        # What a place can gain is bounded by the tables; small numbers keep a block in a core's cache.
        most = sum(2 * k * max(map(abs, values), default=0) for k, values in self.tables)
        out = np.zeros((rows, length, 4), np.int32 if most < 1 << 29 else np.int64)
        for k, values in self.tables:
            n = length - k + 1
            if n <= 0:
                continue
            table, window, every = np.array(values, out.dtype), _windows(codes, k), np.arange(4**k)
            for j in range(k):
                # The windows that have a place as their j-th base: what each gains from each base there.
                unit = 4 ** (k - 1 - j)
                rest = every - every // unit % 4 * unit
                change = table[rest[:, None] + np.arange(4) * unit] - table[:, None]
                out[:, j : j + n] += change[window]
        return out


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    n = codes.shape[1] - k + 1
    out = np.zeros((len(codes), n), np.int64)
    for i in range(k):
        out = out * 4 + codes[:, i : i + n]
    return out


_CODE = np.zeros(256, np.int64)
_CODE[[ord(b) for b in S.BASES]] = range(4)
_BYTES = np.frombuffer(S.BASES.encode(), np.uint8)


def _best(chars: np.ndarray, scorer: WindowScorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, base and gain of each row's best substitution; the leftmost place, then the first base settle ties."""
    codes = _CODE[chars]
    gains = scorer.gains(codes)
    own = np.flatnonzero(S._IS_BASE[chars])
    gains.reshape(-1, 4)[own, codes.reshape(-1)[own]] = np.iinfo(gains.dtype).min >> 1
    cells = gains.reshape(len(chars), -1)
    at = cells.argmax(1)
    return at // 4, at % 4, cells[np.arange(len(chars)), at]


def _blocks(column: pa.Array):
    """(row numbers, characters) of rows of one length, not too many at a time; null and empty rows are left out."""
    body, offsets = S._joined(column)
    size = np.diff(offsets)
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, BLOCK // (4 * length))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, body[offsets[part][:, None] + np.arange(length)]


def _text(chars: np.ndarray) -> list[str]:
    return [r.tobytes().decode("latin-1") for r in chars]


@lru_cache(64)
def _best_udf(scorer: WindowScorer):
    @F.arrow_udf(STEP)
    def best(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        for rows, chars in _blocks(column):
            score = scorer.totals(_CODE[chars])
            place, base, gain = _best(chars, scorer)
            chars[np.arange(len(chars)), place] = _BYTES[base]
            for r, p, b, s, v in zip(rows.tolist(), place.tolist(), base.tolist(), _text(chars), ((score + gain) * scorer.scale).tolist(), strict=True):
                out[r] = {"position": p, "base": S.BASES[b], "candidate": s, "candidate_score": v}
        return pa.array(out, pa.struct([("position", pa.int32()), ("base", pa.string()), ("candidate", pa.string()), ("candidate_score", pa.float64())]))

    return best


def best_flip(df: DataFrame, scorer: WindowScorer, require_gain: bool = False) -> DataFrame:
    """Adds position, base, candidate and candidate_score of each row's best substitution; rows without a base are left out."""
    rows = df.withColumn("_f", _best_udf(scorer)("seq")).where("_f is not null").select(*df.columns, "_f.*")
    return rows.where(F.col("candidate_score") > scorer("seq")) if require_gain else rows


@lru_cache(64)
def _climb_udf(scorer: WindowScorer, budget: int, cap: int | None):
    @F.arrow_udf(StringType())
    def climb(column: pa.Array) -> pa.Array:
        out = column.to_pylist()
        for rows, chars in _blocks(column):
            origin, live = chars.copy(), np.arange(len(chars))
            for _ in range(budget):
                place, base, gain = _best(chars[live], scorer)
                better = gain > 0
                live, place, base = live[better], place[better], base[better]
                if not len(live):
                    break
                then = chars[live]
                then[np.arange(len(live)), place] = _BYTES[base]
                if cap is not None:
                    ok = (then != origin[live]).sum(1) <= cap
                    # A row whose best substitution breaks the cap would find the same one again.
                    live, then = live[ok], then[ok]
                chars[live] = then
            for r, s in zip(rows.tolist(), _text(chars), strict=True):
                out[r] = s
        return pa.array(out, pa.string())

    return climb


def hill_climb(df: DataFrame, scorer: WindowScorer, budget: int, cap: int | None = None, key: str = "pid") -> DataFrame:
    """(key, seq, origin, score): up to ``budget`` best strictly better substitutions within ``cap`` edits of the origin."""
    now = df.select(key, _climb_udf(scorer, budget, cap)("seq").alias("seq"), F.col("seq").alias("origin"))
    return now.withColumn("score", scorer("seq"))


@lru_cache(64)
def _walk_udf(scorer: WindowScorer, generations: int):
    kind = pa.list_(pa.struct([("position", pa.int32()), ("base", pa.string()), ("candidate", pa.string()), ("candidate_score", pa.float64())]))

    @F.arrow_udf(ArrayType(STEP))
    def walk(column: pa.Array) -> pa.Array:
        out: list = [[] for _ in range(len(column))]
        for rows, chars in _blocks(column):
            score = scorer.totals(_CODE[chars])
            for _ in range(generations):
                place, base, gain = _best(chars, scorer)
                chars[np.arange(len(chars)), place] = _BYTES[base]
                score = score + gain
                for r, p, b, s, v in zip(rows.tolist(), place.tolist(), base.tolist(), _text(chars), (score * scorer.scale).tolist(), strict=True):
                    out[r].append({"position": p, "base": S.BASES[b], "candidate": s, "candidate_score": v})
        return pa.array(out, kind)

    return walk


def ism_trajectory(df: DataFrame, scorer: WindowScorer, generations: int, key: str = "pid") -> DataFrame:
    """(key, seq, generation, score, position, base): the row itself, then every generation's best substitution, even if it lowers the score."""
    first = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("base"), F.col("seq").alias("candidate"), scorer("seq").alias("candidate_score")))
    rows = df.select(key, F.posexplode(F.concat(first, _walk_udf(scorer, generations)("seq"))).alias("generation", "_s"))
    return rows.select(key, F.col("_s.candidate").alias("seq"), "generation", F.col("_s.candidate_score").alias("score"), "_s.position", "_s.base")


def with_candidates(df: DataFrame, seq: str = "seq", out: str = "candidates") -> DataFrame:
    """``df`` with all 3 L single substitutions of each row: an array of (position from 0, base, candidate), in this order.

    For scorers that look at whole candidates. Rows without a base get an empty array.
    """
    item = StructType(STEP.fields[:3])
    kind = pa.struct([("position", pa.int32()), ("base", pa.string()), ("candidate", pa.string())])
    names = np.array(list(S.BASES))

    def run(batches):
        for whole in batches:
            # About a sixteenth of ``CELLS`` characters of candidates at a time, by the longest row.
            size = int(np.diff(S._joined(whole.column(seq))[1]).max(initial=1))
            step = max(1, CELLS * 4 // (3 * size * size + 1))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                body, offsets = S._joined(batch.column(seq))
                length = np.diff(offsets)
                row_of = np.repeat(np.arange(batch.num_rows), length)
                site, base = np.nonzero(body[:, None] != _BYTES)
                row = row_of[site]
                places = (site - offsets[row]).astype(np.int32)
                ends = np.r_[0, np.cumsum(length[row])]
                chars = body[np.repeat(offsets[row] - ends[:-1], length[row]) + np.arange(ends[-1])]
                chars[ends[:-1] + places] = _BYTES[base]
                text = pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chars)])
                items = pa.StructArray.from_arrays([pa.array(places), pa.array(names[base], pa.string()), text], fields=list(kind))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield batch.append_column(out, pa.ListArray.from_arrays(pa.array(bounds), items))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(item))]))


BOUNDS = StructType([StructField("candidates", LongType()), StructField("first", StringType()), StructField("last", StringType())])


@F.arrow_udf(BOUNDS)
def _bounds(column: pa.Array) -> pa.Array:
    count, ends = np.zeros(len(column), np.int64), [[None] * len(column), [None] * len(column)]
    for rows, chars in _blocks(column):
        count[rows] = 4 * chars.shape[1] - S._IS_BASE[chars].sum(1)
        every, last = np.arange(len(chars)), chars.shape[1] - 1
        for out, (to, instead) in zip(ends, ((_BYTES[0], _BYTES[1]), (_BYTES[3], _BYTES[2])), strict=True):
            # The first place that the outermost base betters; without one, the last place loses the least.
            better = chars > to if to == _BYTES[0] else chars < to
            some = better.any(1)
            place = np.where(some, better.argmax(1), last)
            new = chars.copy()
            new[every, place] = np.where(some | (chars[:, last] != to), to, instead)
            for r, s in zip(rows.tolist(), _text(new), strict=True):
                out[r] = s
    return pa.StructArray.from_arrays([pa.array(count), *(pa.array(x, pa.string()) for x in ends)], ["candidates", "first", "last"])


def candidate_bounds(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` with how many single substitutions each row has, and the first and the last of them in the alphabet.

    The same as from ``with_candidates``, read off the row itself: none of the 3 L
    candidates is written out. Rows without a base have none.
    """
    return df.withColumn("_b", _bounds(seq)).select(*df.columns, "_b.*")
