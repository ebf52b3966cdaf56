"""A population as rows of many sequences each, for annealing without a shuffle of sequences.

A block is a run of neighbouring ``pid``s: their bases two bits each, the number
of the seed that each descends from, and their fitness as places in the block's
distinct values, which are few where scores are counts. Blocks are Parquet files;
jobs over the fitness alone read no sequence. A step's resampling needs the sum
of weights before each block, one number a block on the driver; copies, branches,
scores and the choice among them then stay in the block, and the new ``pid``s
follow from the running sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import draws
from helixframe.functions import sequence as S
from helixframe.functions.lineage import delete, new_path
from helixframe.operators import resample
from helixframe.operators.relational import numbered

#: Rows to a block, and rows whose branches are drawn and scored together.
SIZE, TOGETHER = 4096, 512
#: Distinct values that blocks may have for the driver to get them all: 2 KB for 4096 rows. Beyond that they are summed by jobs.
FEW = 128
SCHEMA = "first long, n long, seq binary, origin binary, place binary, values array<double>, counts array<long>, task int"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: By bits 1 and 2 of their ASCII codes, which tell the four bases apart.
_BASES, _DRAWN = np.frombuffer(b"ACTG", np.uint8), np.frombuffer(S.BASES.encode(), np.uint8)
_FOUR = _BASES[np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3].copy().view(np.uint32).reshape(-1)


def packed(letters: np.ndarray) -> np.ndarray:
    """Rows of bases as rows of bytes with four bases each; the last is filled up."""
    width = -(-letters.shape[1] // 4) * 4
    code = np.zeros((len(letters), width), np.uint8)
    code[:, : letters.shape[1]] = letters >> 1 & 3
    four = code.view("<u4")
    return (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)


def unpacked(rows: np.ndarray, length: int) -> np.ndarray:
    return _FOUR[rows].view(np.uint8)[:, :length]


class _Writer:
    """Gathers runs of rows and hands them on as blocks of at most ``size`` rows; runs that follow each other are joined."""

    def __init__(self, size: int):
        self.size, self.runs = size, []
        self.first = self.next = 0

    def add(self, first: int, seq: np.ndarray, origin: np.ndarray, fitness: np.ndarray):
        if self.runs and first != self.next:
            yield from self.flush(1)
        if not self.runs:
            self.first = self.next = first
        self.runs.append((seq, origin, fitness))
        self.next += len(seq)
        yield from self.flush(self.size)

    def flush(self, least: int = 1):
        """Blocks for as long as there are ``least`` rows."""
        if self.next - self.first < least or not self.runs:
            return
        seq, origin, fitness = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        task, at = TaskContext.get().partitionId(), 0
        while len(seq) - at >= least:
            s = slice(at, min(at + self.size, len(seq)))
            values, place, counts = np.unique(fitness[s], return_inverse=True, return_counts=True)
            row = (self.first + at, s.stop - at, seq[s].tobytes(), origin[s].astype("<i8").tobytes(), place.astype("<u2").tobytes(), values.tolist(), counts.tolist(), task)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)
            at = s.stop
        self.first += at
        self.runs = [(seq[at:], origin[at:], fitness[at:])] if at < len(seq) else []


_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int32()]


def _bytes(batch: pa.RecordBatch, name: str, r: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(name)[r].as_buffer(), kind)


def _packed_texts(batches):
    """(pid, size, seq) of (pid, seq): the length, and the bases packed; null for what isn't of bases alone."""
    for batch in batches:
        body, offsets = S._joined(batch.column("seq"))
        size = np.diff(offsets)
        strange = np.flatnonzero(~np.isin(body, _DRAWN))
        bad = np.zeros(len(size), bool)
        bad[np.searchsorted(offsets, strange, "right") - 1] = True
        out: list = [None] * len(size)
        for length in np.unique(size[size > 0]).tolist():
            same = np.flatnonzero((size == length) & ~bad)
            for r, row in zip(same.tolist(), packed(body[offsets[same][:, None] + np.arange(length)]), strict=True):
                out[r] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(size, pa.int32()), pa.array(out, pa.binary())], ["pid", "size", "seq"])


@dataclass
class Blocks:
    """One generation."""

    spark: SparkSession
    path: str
    n: int
    length: int
    size: int = SIZE
    #: (first, n, task) of all blocks in order, and the distinct values of all rows unless a block has over ``FEW``; how many rows of which block have which.
    blocks: list[tuple[int, int, int]] = field(default_factory=list)
    values: np.ndarray | None = None
    cells: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def _written(rows: DataFrame, n: int, length: int, size: int) -> Blocks:
        path = new_path(rows.sparkSession, "generation")
        rows.write.option("compression", "none").parquet(path)
        out = Blocks(rows.sparkSession, path, n, length, size)
        few = F.size("values") <= FEW
        got = out.table().select("first", "n", "task", F.when(few, F.col("values")).alias("values"), F.when(few, F.col("counts")).alias("counts")).toArrow().sort_by("first")
        out.blocks = list(zip(*(got.column(c).to_pylist() for c in ("first", "n", "task")), strict=True))
        if not got.column("values").null_count:
            values, counts = (got.column(c).combine_chunks() for c in ("values", "counts"))
            out.values, which = np.unique(values.flatten().to_numpy(), return_inverse=True)
            out.cells = np.repeat(np.arange(len(got)), np.diff(values.offsets.to_numpy())), which, counts.flatten().to_numpy()
        return out

    @staticmethod
    def of(seeds: DataFrame, values: Callable[[np.ndarray], np.ndarray], size: int = SIZE) -> Blocks | None:
        """From (pid, seq) in the order of pid; None unless all sequences are of bases and of one length."""
        spark, path = seeds.sparkSession, new_path(seeds.sparkSession, "seeds")
        kinds = f"pid {dict(seeds.dtypes)['pid']}, size int, seq binary"
        seeds.select("pid", "seq").mapInArrow(_packed_texts, kinds).write.option("compression", "none").parquet(path)
        rows = spark.read.schema(kinds).parquet(path)
        told = rows.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("top"), F.count("seq").alias("whole")).first()
        if not told["n"] or told["low"] != told["top"] or told["whole"] < told["n"]:
            delete(spark, path)
            return None
        length, width = told["top"], -(-told["top"] // 4)

        def run(batches):
            out = _Writer(size)
            for batch in batches:
                pid = batch.column("pid").to_numpy()
                every = np.frombuffer(b"".join(batch.column("seq").to_pylist()), np.uint8).reshape(-1, width)
                for part in np.split(np.arange(len(pid)), np.flatnonzero(np.diff(pid) != 1) + 1):
                    for at in range(0, len(part), TOGETHER):
                        p = part[at : at + TOGETHER]
                        yield from out.add(int(pid[p[0]]), every[p], pid[p], _scores(values, unpacked(every[p], length)))
            yield from out.flush()

        made = numbered(rows.select("pid", "seq"), "pid", "_n").select(F.col("_n").alias("pid"), "seq")
        out = Blocks._written(made.mapInArrow(run, SCHEMA), told["n"], length, size)
        delete(spark, path)
        return out

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def fitness(self) -> DataFrame:
        """(fitness, c): how many rows of a block have a value."""
        return self.table().select(F.inline(F.arrays_zip("values", "counts"))).toDF("fitness", "c")

    def rows(self, start: Blocks) -> DataFrame:
        """(pid, seq, origin, fitness, log_p), with the sequences of ``start`` as origins."""
        own = self._rows()
        if start.path == self.path:
            return own.select("pid", "seq", F.col("seq").alias("origin"), "fitness", F.lit(0.0).alias("log_p"))
        first = start._rows().select(F.col("pid").alias("_origin"), F.col("seq").alias("origin"))
        return own.join(first, "_origin").select("pid", "seq", "origin", "fitness", F.lit(0.0).alias("log_p"))

    def _rows(self) -> DataFrame:
        length, width = self.length, -(-self.length // 4)

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    letters = np.ascontiguousarray(unpacked(_bytes(batch, "seq", r, np.uint8).reshape(-1, width), length))
                    n, first = len(letters), batch.column("first")[r].as_py()
                    text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * length, length, dtype=np.int32)), pa.py_buffer(letters)])
                    fitness = np.array(batch.column("values")[r].as_py())[_bytes(batch, "place", r, "<u2")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), text, pa.array(_bytes(batch, "origin", r, "<i8")), pa.array(fitness)], ["pid", "seq", "_origin", "fitness"])

        return self.table().mapInArrow(run, "pid long, seq string, _origin long, fitness double")

    def drop(self, release: bool = True) -> None:
        delete(self.spark, self.path, release)

    def n_unique(self) -> int:
        """Distinct sequences, told apart by 128 bits; those of a task are met before the shuffle."""
        width, many = -(-self.length // 4), int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def told(batches):
            parts = [_marks(_bytes(b, "seq", r, np.uint8).reshape(-1, width)) for b in batches for r in range(b.num_rows)]
            marks = _distinct(np.concatenate(parts)) if parts else np.zeros((0, 2), np.uint64)
            part = marks[:, 1] % np.uint64(many)
            for p in range(many):
                if len(mine := marks[part == p]):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([mine.tobytes()], pa.binary())], ["part", "marks"])

        def counted(batches):
            parts: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for r, p in enumerate(b.column("part").to_pylist()):
                    parts.setdefault(p, []).append(_bytes(b, "marks", r, np.uint64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(_distinct(np.concatenate(x))) for x in parts.values())], pa.int64())], ["c"])

        marks = self.table().select("seq").mapInArrow(told, "part int, marks binary").repartition(many, "part")
        return marks.mapInArrow(counted, "c long").agg(F.sum("c")).first()[0]

    def weighed(self, delta: float, top: float, heat: float) -> tuple[DataFrame, np.ndarray | None, float, float, list[int]]:
        """(blocks, weights of ``values`` as whole numbers, effective size, log of the mean weight, sum of the whole weights of each block).

        Without ``values``, the weights are a column ``whole`` of the blocks, and a job that reads the values alone sums them.
        """
        heat, unit, rows = max(1.0, heat), float((1 << 62) // self.n), self.table()
        if self.values is not None:
            log = delta * self.values - delta * top
            whole = np.array([math.floor(math.exp(x / heat) * unit) for x in log.tolist()], np.int64)
            block, which, counts = self.cells
            weights = np.zeros(len(self.blocks), np.int64)
            np.add.at(weights, block, whole[which] * counts)
            ess, mean = self._sums().told(delta, top)
            return rows, whole, ess, mean, weights.tolist()
        shifted = lambda v: F.lit(delta) * v - F.lit(delta * top)
        weight = lambda v: F.exp(shifted(v))
        total = lambda zero, x, f: F.aggregate(F.zip_with(x, "counts", f), F.lit(zero).cast("long" if x == "whole" else "double"), lambda a, v: a + v)
        rows = rows.withColumn("whole", F.transform("values", lambda v: F.floor(F.exp(shifted(v) / F.lit(heat)) * F.lit(unit)).cast("long")))
        got = rows.select("first", total(0, "whole", lambda w, c: w * c).alias("w"), total(0.0, "values", lambda v, c: c * weight(v)).alias("s"), total(0.0, "values", lambda v, c: c * weight(v) * weight(v)).alias("q")).collect()
        s, q = (math.fsum(r[c] for r in got) for c in "sq")
        return rows, None, _effective(s, q), delta * top + math.log(s / self.n), [r["w"] for r in sorted(got, key=lambda r: r["first"])]

    def _sums(self) -> _Sums:
        return _Sums(self.values, np.bincount(self.cells[1], self.cells[2]))

    def largest_step(self, remaining: float, share: float) -> float:
        if self.values is None:
            return resample.largest_step(self.fitness(), "fitness", remaining, share, count="c")
        return remaining if len(self.values) == 1 else resample.searched(self._sums(), remaining, share * self.n)

    def summary(self) -> dict:
        """Mean, largest and spread of the fitness, and distinct sequences."""
        if self.values is not None:
            counts = self._sums().counts
            mean = float((counts * self.values).sum() / self.n)
            one = {"mean": mean, "max": float(self.values[-1]), "std": math.sqrt(float((counts * (self.values - mean) ** 2).sum()) / self.n)}
        else:
            one = self.fitness().agg((F.sum(F.col("fitness") * F.col("c")) / F.sum("c")).alias("mean"), F.max("fitness").alias("max")).first().asDict()
            gap = F.col("fitness") - F.lit(one["mean"])
            one["std"] = self.fitness().agg(F.sqrt(F.sum(F.col("c") * gap * gap) / F.sum("c"))).first()[0]
        return one | {"n_unique": self.n_unique(), "n": sum(n for _, n, _ in self.blocks)}

    def best(self) -> float:
        return float(self.values[-1]) if self.values is not None else self.fitness().agg(F.max("fitness")).first()[0]

    def grown(self, weighed: DataFrame, whole: np.ndarray | None, sums: list[int], u0: float, values: Callable[[np.ndarray], np.ndarray], rate: float, seed: int, branches: int, step: int) -> Blocks:
        """The next generation: systematic copies in the order of pid, ``branches`` proposals of each copy as by ``Sparse``, and the best one, the first on ties."""
        n, length, size, width = self.n, self.length, self.size, -(-self.length // 4)
        weights, known = np.array(sums, np.int64), self.values
        total, after = int(weights.sum()), np.cumsum(weights)
        before = dict(zip((f for f, *_ in self.blocks), (after - weights).tolist(), strict=True))
        key = draws.key(seed, "sparse", step)

        def points(upto: np.ndarray) -> np.ndarray:
            at = np.minimum(np.floor(n * (upto / total) - u0).astype(np.int64), n - 1)
            return np.where(upto <= 0, -1, np.where(upto >= total, n - 1, at))

        def run(batches):
            out = _Writer(size)
            for batch in batches:
                cut = batch.column("piece").to_pylist() if "piece" in batch.schema.names else [None] * batch.num_rows
                for r, piece in enumerate(cut):
                    w = np.array(batch.column("whole" if whole is None else "values")[r].as_py())
                    w = (w if whole is None else whole[np.searchsorted(known, w)])[_bytes(batch, "place", r, "<u2")]
                    upto = np.cumsum(w) + before[batch.column("first")[r].as_py()]
                    here, prior = points(upto), points(upto - w)
                    parent = np.repeat(np.arange(len(w)), np.maximum(here - prior, 0))
                    first = int(prior[0]) + 1
                    if piece is not None:
                        low, high = max(piece * size - first, 0), min(max((piece + 1) * size - first, 0), len(parent))
                        parent, first = parent[low:high], first + low
                    seq, origin = _bytes(batch, "seq", r, np.uint8).reshape(-1, width), _bytes(batch, "origin", r, "<i8")
                    for at in range(0, len(parent), TOGETHER):
                        p = parent[at : at + TOGETHER]
                        grid = np.repeat(unpacked(seq[p], length), branches, 0)
                        pid = np.repeat(np.arange(first + at, first + at + len(p)), branches)
                        draws.redraw(grid, draws.stems(key, pid, np.tile(np.arange(branches), len(p))), rate, _DRAWN)
                        score = _scores(values, grid).reshape(-1, branches)
                        best = np.arange(len(p)) * branches + np.where(np.isnan(score), -np.inf, score).argmax(1)
                        yield from out.add(first + at, packed(grid[best]), origin[p], score.reshape(-1)[best])
            yield from out.flush()

        bounds = points(np.r_[0, after])
        made: dict[int, int] = {}
        for (*_, task), c in zip(self.blocks, np.diff(bounds).tolist(), strict=True):
            made[task] = made.get(task, 0) + c
        rows = weighed.select("first", "seq", "origin", "place", "values" if whole is not None else "whole")
        if max(made.values()) > 2 * n / len(made) + size:
            # The rows that would descend from one file are too many for a task: pieces of the next generation are dealt anew, each with the blocks that it comes from.
            side = [(f, int(a + 1) // size, int(b) // size) for (f, *_), a, b in zip(self.blocks, bounds[:-1], bounds[1:], strict=True) if b > a]
            side = self.spark.createDataFrame(side, "first long, _low long, _high long")
            rows = rows.join(F.broadcast(side), "first").withColumn("piece", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
            many = max(len(made), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            rows = rows.repartitionByRange(many, "piece").sortWithinPartitions("piece", "first")
        return Blocks._written(rows.mapInArrow(run, SCHEMA), n, length, size)


def _scores(values: Callable[[np.ndarray], np.ndarray], letters: np.ndarray) -> np.ndarray:
    return np.asarray(values(letters), float)


def _marks(rows: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each row of bytes, all of it mixed into both."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view("<u8")
    out = np.empty((len(rows), 2), np.uint64)
    for k in range(2):
        out[:, k] = draws.stems(k + 1, *(words[:, i].view(np.int64) for i in range(words.shape[1])))
    return out


def _distinct(marks: np.ndarray) -> np.ndarray:
    order = np.argsort(marks[:, 0])
    marks = marks[order]
    same = marks[1:, 0] == marks[:-1, 0]
    if (same & (marks[1:, 1] != marks[:-1, 1])).any():  # rows of one first word stand in any order
        marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
        same = marks[1:, 0] == marks[:-1, 0]
    return marks[np.r_[True, ~(same & (marks[1:, 1] == marks[:-1, 1]))][: len(marks)]]


def _effective(s: float, q: float) -> float:
    return 0.0 if s < 1e-300 or q <= 0 else s * s / q


class _Sums:
    """Sums of weights, as functions of the temperature step, of a few values and how many rows have each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts

    def effective(self, step: float) -> float:
        return self.told(step, float(self.values[-1]))[0]

    def told(self, step: float, top: float) -> tuple[float, float]:
        """(effective size, log of the mean weight)."""
        w = np.exp(step * self.values - step * top)
        s = float((self.counts * w).sum())
        return _effective(s, float((self.counts * w * w).sum())), step * top + math.log(s / self.counts.sum())
