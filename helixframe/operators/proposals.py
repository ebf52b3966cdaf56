"""Proposals, branch choice, mutagenesis and scorers.

A proposal takes (pid, seq, ...) and gives (pid, k, seq); a scorer adds columns
to rows with ``seq``. Both may be column expressions or ``mapInPandas`` with a
model; ``PandasScorer`` is the seam for the latter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from helixframe.functions import digests, draws, rng
from helixframe.functions import fitness as fit
from helixframe.functions import sequence as S
from helixframe.functions.lineage import cut
from helixframe.operators import mutagenesis
from helixframe.operators.mutagenesis import WindowScorer

#: Rows of a batch that are drawn together.
ROWS = 4096
_BASES = np.frombuffer(S.BASES.encode(), np.uint8)
# Multiplier and shift of the three linear 3-mer scorers.
CELLS = {"c1": (5, 3), "c2": (7, 1), "c3": (11, 6)}


class Proposal(Protocol):
    def expand(self, df: DataFrame, branches: int, step: int) -> DataFrame: ...


class Scorer(Protocol):
    """One that also has ``values`` (a number for each row of a matrix of letters, ``score`` of the row) can be annealed by blocks."""

    def score(self, df: DataFrame) -> DataFrame: ...


@dataclass
class Masked:
    """Each position is redrawn with probability ``rate``, or exactly max(1, int(rate L)) positions are.

    ``shared``: the branches of a row share their mask.
    """

    rate: float
    seed: int
    shared: bool = False
    exact: bool = False
    rates: tuple[float, ...] = ()

    def expand(self, df: DataFrame, branches: int, step: int) -> DataFrame:
        rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
        return rows.withColumn("seq", self.mutated(F.col("seq"), F.col("pid"), F.col("k"), step))

    def mutated(self, seq: Column, pid: Column, k: Column, step: int) -> Column:
        mask_keys = (pid, F.lit(step)) if self.shared else (pid, k, F.lit(step))
        rate: Column = F.lit(self.rate)
        if self.rates:  # a kernel for each row, drawn from a list of rates
            pick = F.floor(rng.uniform(self.seed, "kernel", pid, F.lit(step)) * len(self.rates)).cast("int")
            rate = F.get(F.array(*map(F.lit, self.rates)), pick)
        return _redrawn(self.exact)(seq, rng.stem(self.seed, "mask", *mask_keys), rng.stem(self.seed, "base", pid, k, F.lit(step)), rate.cast("double"))


@lru_cache(2)
def _redrawn(exact: bool):
    """Of (sequence, stem of the mask's draws, stem of the bases' draws, rate): the sequence with its masked places drawn anew."""

    @F.arrow_udf(StringType())
    def redrawn(seq: pa.Array, mask: pa.Array, base: pa.Array, rate: pa.Array) -> pa.Array:
        body, offsets = S._joined(seq)
        body, size, rates = body.copy(), np.diff(offsets), rate.to_numpy(zero_copy_only=False)
        heads, bases = (rng.heads(x) for x in (mask, base))
        for length in np.unique(size[size > 0]).tolist():
            same, places = np.flatnonzero(size == length), rng.tails(length)
            for at in range(0, len(same), ROWS):
                part = same[at : at + ROWS]
                u = digests.every([heads[r] for r in part.tolist()], places)[:, :, 0] / 2.0**32
                hit = u < rates[part][:, None]
                if exact:
                    n = np.maximum(1, np.floor(rates[part] * length)).astype(np.int64)
                    hit = np.zeros(u.shape, bool)
                    np.put_along_axis(hit, np.argsort(u, axis=1, kind="stable"), np.arange(length) < n[:, None], 1)
                row, place = np.nonzero(hit)
                word = digests.some([bases[r] for r in part.tolist()], places, row, place)
                body[offsets[part[row]] + place] = _BASES[word >> 30]
        none = np.packbits(~seq.is_null().to_numpy(zero_copy_only=False), bitorder="little")
        return pa.Array.from_buffers(pa.string(), len(seq), [pa.py_buffer(none), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])

    return redrawn


@dataclass
class Sparse:
    """Each position is redrawn with probability ``rate``, as by ``Masked``, but only redrawn ones cost a draw.

    A draw tells how many positions are passed over until the next one, and its
    new base; ``functions/draws.py`` has the numbers, which are the same for any
    partitioning. They are others than those of ``Masked``.
    """

    rate: float
    seed: int

    def expand(self, df: DataFrame, branches: int, step: int) -> DataFrame:
        rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
        return rows.withColumn("seq", _sparsely(self.rate, draws.key(self.seed, "sparse", step))(F.col("seq"), F.col("pid").cast("long"), F.col("k").cast("long")))


@lru_cache(64)
def _sparsely(rate: float, key: int):
    @F.arrow_udf(StringType())
    def redrawn(seq: pa.Array, pid: pa.Array, k: pa.Array) -> pa.Array:
        body, offsets = S._joined(seq)
        body, size = body.copy(), np.diff(offsets)
        stems = draws.stems(key, *(np.asarray(x.fill_null(0)).astype(np.int64) for x in (pid, k)))
        for length in np.unique(size[size > 0]).tolist():
            same = np.flatnonzero(size == length)
            for at in range(0, len(same), ROWS):
                part = same[at : at + ROWS]
                where = offsets[part][:, None] + np.arange(length)
                grid = body[where]
                draws.redraw(grid, stems[part], rate, _BASES)
                body[where] = grid
        none = np.packbits(~seq.is_null().to_numpy(zero_copy_only=False), bitorder="little")
        return pa.Array.from_buffers(pa.string(), len(seq), [pa.py_buffer(none), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])

    return redrawn


def cell_scores(seq: Column | str = "seq") -> dict[str, Column]:
    """Three linear 3-mer scorers: sums of whole numbers and one division."""
    s = F.col(seq) if isinstance(seq, str) else seq
    per = F.greatest(F.length(s) - 2, F.lit(0)) * F.lit(8.0)
    return {name: S.kmer_table_sum(s, tuple((i * a + b) % 17 - 8 for i in range(64))) / F.nullif(per, F.lit(0.0)) for name, (a, b) in CELLS.items()}


@dataclass
class CellScorer:
    """All cells as columns ``score_<cell>``; unused ones are pruned."""

    cells: tuple[str, ...] = ("c1", "c2", "c3")

    def score(self, df: DataFrame) -> DataFrame:
        every = cell_scores()
        return df.withColumns({f"score_{c}": every[c] for c in self.cells})


@dataclass
class MotifScorer:
    motif: str = "GATA"

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", S.motif_count("seq", self.motif).cast("double"))

    def values(self, letters: np.ndarray) -> np.ndarray:
        """The scores of a batch: a row of ``letters`` is a sequence."""
        motif, length = self.motif.encode(), letters.shape[1]
        n = length - len(motif) + 1
        if not motif or n <= 0:
            return np.full(len(letters), float(0 if motif else length + 1))
        # All rows end to end, for speed; places whose motif would begin beyond a row's last aren't counted.
        flat = np.ascontiguousarray(letters).reshape(-1)
        many = max(len(flat) - len(motif) + 1, 0)
        hit = flat[:many] == motif[0]
        for i, c in enumerate(motif[1:], 1):
            hit &= flat[i : i + many] == c
        row, place = np.divmod(np.flatnonzero(hit), length)
        return np.bincount(row[place < n], minlength=len(letters)).astype(float)


@dataclass
class PandasScorer:
    """The seam for models: ``predict`` gets a list of sequences in a worker and returns a number for each."""

    predict: Callable[[list[str]], np.ndarray]
    name: str = "score"
    strands: bool = False

    def score(self, df: DataFrame) -> DataFrame:
        predict, name, strands = self.predict, self.name, self.strands
        flip = str.maketrans("ACGT", "TGCA")

        def run(batches):
            for batch in batches:
                seqs = batch["seq"].tolist()
                values = np.asarray(predict(seqs), float) if seqs else np.zeros(0)
                if strands and seqs:
                    values = (values + np.asarray(predict([s.translate(flip)[::-1] for s in seqs]), float)) / 2
                yield batch.assign(**{name: values})

        return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


@dataclass
class InjectingScorer:
    """Scores the core between its adapters by another scorer; the rows keep their core."""

    inner: Scorer

    def score(self, df: DataFrame) -> DataFrame:
        core = F.col("seq").alias("_core")
        scored = self.inner.score(df.select("*", core).withColumn("seq", S.inject_adapters("seq")))
        return scored.withColumn("seq", F.col("_core")).drop("_core")


@dataclass
class NeighbourLikelihood:
    """Pseudo-log-likelihood of masked bases, given both neighbours, from a pool's 3-mer counts.

    Each inner base is masked with probability ``rate`` by the hash PRNG; the
    score is the sum of ln P(base | left, right) over masked ones, with one
    count added to each base. It stands where a masked model's likelihood would.
    """

    counts: dict[str, int]
    rate: float = 0.15
    seed: int = 0

    @staticmethod
    def of(pool: DataFrame, rate: float = 0.15, seed: int = 0) -> NeighbourLikelihood:
        """From a profile (kmer, n) of 3-mers: a fixed number of rows."""
        return NeighbourLikelihood({r["kmer"]: r["n"] for r in pool.select("kmer", "n").limit(64).collect()}, rate, seed)

    def score(self, df: DataFrame) -> DataFrame:
        n = {k: self.counts.get(k, 0) + 1 for k in (a + b + c for a in S.BASES for b in S.BASES for c in S.BASES)}
        told = np.array([float(np.log(n[k] / sum(n[k[0] + b + k[2]] for b in S.BASES))) for k in n])
        rate = self.rate

        @F.arrow_udf(DoubleType())
        def total(seq: pa.Array, stem: pa.Array) -> pa.Array:
            row, number = S.kmer_codes(seq, 3)
            size = np.bincount(row, minlength=len(seq))
            heads, out = rng.heads(stem), np.zeros(len(seq))
            first = np.cumsum(size) - size
            for length in np.unique(size[size > 0]).tolist():
                same, places = np.flatnonzero(size == length), rng.tails(length + 1)[1:]
                for at in range(0, len(same), ROWS):
                    part = same[at : at + ROWS]
                    hit = digests.every([heads[r] for r in part.tolist()], places)[:, :, 0] / 2.0**32 < rate
                    r, i = np.nonzero(hit)
                    out[part] = np.bincount(r, told[number[first[part[r]] + i]], len(part))
            return pa.array(out, mask=seq.is_null().to_numpy(zero_copy_only=False))

        return df.withColumn("score", total("seq", rng.stem(self.seed, "ppl", "pid")))


def mean_likelihood(df: DataFrame, counts: dict[str, int], rates: list[float], seed: int = 0) -> DataFrame:
    """Adds ``approx_ll``: minus the mean over masking rates of the summed negative log-likelihood."""
    out, names = df, []
    for i, rate in enumerate(rates):
        names.append(f"_ll{i}")
        out = NeighbourLikelihood(counts, rate, seed + i).score(out).withColumnRenamed("score", names[-1])
    return out.withColumn("approx_ll", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def sampled_check(df: DataFrame, scorer: Scorer, known: str, n: int, seed: int, score: str = "score") -> DataFrame:
    """One row: how far a scorer is from known values on n rows drawn by hash (n, largest and mean difference, correlation)."""
    drawn = scorer.score(df.orderBy(rng.order_key(seed, "pid"), "pid").limit(n))
    gap = F.abs(F.col(score) - F.col(known))
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("largest"), F.avg(gap).alias("mean"), F.corr(score, known).alias("r"))


def cascade(df: DataFrame, fast: Scorer, accurate: Scorer, keep: int, fast_name: str, group: str = "pid") -> DataFrame:
    """Only the ``keep`` best of each group by the fast score reach the accurate one."""
    order = Window.partitionBy(group).orderBy(F.desc(fast_name), "k")
    best = fast.score(df).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")
    return accurate.score(best)


def remembered(df: DataFrame, memo: DataFrame, scorer: Scorer, name: str = "score") -> tuple[DataFrame, DataFrame]:
    """(rows with scores, memo with the new ones): known sequences are not scored again."""
    new = scorer.score(df.select("seq").distinct().join(memo, "seq", "left_anti")).select("seq", name)
    memo = memo.select("seq", name).unionByName(new)
    return df.join(memo, "seq", "left"), memo


def chosen_branch(df: DataFrame, score: str, length: int, cap: int | None = None, step_cap: int | None = None, criterion: str = "oracle", tau: float = 0.0, seed: int = 0, step: int = 0) -> DataFrame:
    """One branch for each pid, or its parent where none is valid.

    Rows: pid, k, seq, parent, origin, score. ``criterion``: the score, or score / (1 + edits).
    tau 0: the largest, first k on ties. Else a draw from the softmax of criterion / tau,
    with the log of the drawn branch's chance as ``log_p``.
    """
    edits = S.hamming("seq", "origin")
    ok = F.lit(True) if cap is None else edits <= cap
    if step_cap is not None:
        ok = ok & (S.hamming("seq", "parent") <= step_cap)
    value = fit.efficiency(score, edits) if criterion == "efficiency" else F.col(score)
    rows = df.withColumns({"_ok": ok, "_v": value.cast("double"), "_p": F.lit(0.0)})
    if tau > 0:
        whole = Window.partitionBy("pid")
        order = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        w = F.when(F.col("_ok"), F.exp((F.col("_v") - F.max(F.when(F.col("_ok"), F.col("_v"))).over(whole)) / tau)).otherwise(0.0)
        rows = rows.withColumn("_w", w).withColumns({"_c": F.sum("_w").over(order), "_t": F.sum("_w").over(whole)})
        past = rows.withColumn("_v", F.when(F.col("_c") / F.col("_t") > rng.uniform(seed, "tau", "pid", F.lit(step)), -F.col("k").cast("double")).otherwise(float("-inf")))
        rows = past.withColumn("_p", F.when(F.col("_ok"), F.log(F.greatest(F.col("_w") / F.col("_t"), F.lit(1e-30)))).otherwise(0.0)).drop("_w", "_c", "_t")
    rest = [c for c in df.columns if c != "pid"]
    order = F.struct((~F.col("_ok")).alias("bad"), (-F.col("_v")).alias("v"), F.col("k"))
    best = rows.groupBy("pid").agg(F.min_by(F.struct(*rest, "_ok", "_p"), order).alias("_b"))
    out = best.select("pid", *(F.col(f"_b.{c}").alias(c) for c in rest), F.col("_b._ok").alias("valid"), F.when(F.col("_b._ok"), F.col("_b._p")).otherwise(0.0).alias("log_p"))
    return out.withColumn("seq", F.when(F.col("valid"), F.col("seq")).otherwise(F.col("parent")))


def prefiltered(df: DataFrame, j: int, value: str) -> DataFrame:
    """The j branches of each pid with the largest value (log-probability or surrogate score)."""
    order = Window.partitionBy("pid").orderBy(F.desc(value), "k")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= j).drop("_n")


def ridge_surrogate(df: DataFrame, score: str, alpha: float = 1.0, k: int = 3) -> np.ndarray:
    """Weights (4^k and an intercept) of a ridge regression on k-mer counts.

    The normal equations are a fixed 65 x 65 sum, built by partial sums over
    sparse pairs of counts; no row comes to the driver.
    """
    n = 4**k

    def run(batches):
        a, b = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
        digits = str.maketrans("ACGT", "0123")
        for batch in batches:
            x = np.ones((len(batch), n + 1))
            for r, text in enumerate(batch["seq"]):
                code = np.frombuffer(text.translate(digits).encode(), np.uint8).astype(np.int64) - 48
                index = sum(code[i : len(code) - k + 1 + i] * 4 ** (k - 1 - i) for i in range(k))
                x[r, :n] = np.bincount(index, minlength=n)
            a += x.T @ x
            b += x.T @ batch["y"].to_numpy(float)
        import pandas as pd

        i, j = np.nonzero(a)
        yield pd.DataFrame({"i": np.r_[i, np.arange(n + 1)], "j": np.r_[j, np.full(n + 1, -1)], "v": np.r_[a[i, j], b]})

    rows = df.select("seq", F.col(score).cast("double").alias("y"))
    sums = rows.mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    a, b = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
    for r in sums:
        if r["j"] < 0:
            b[r["i"]] = r["v"]
        else:
            a[r["i"], r["j"]] = r["v"]
    mean = a[-1, :n] / max(a[-1, -1], 1)
    centred = a[:n, :n] - a[-1, -1] * np.outer(mean, mean)
    w = np.linalg.solve(centred + alpha * np.eye(n), b[:n] - b[-1] * mean)
    return np.r_[w, (b[-1] / max(a[-1, -1], 1)) - mean @ w]


def surrogate_score(weights: np.ndarray, seq: str = "seq", k: int = 3) -> Column:
    """The intercept and the weights of all k-mers, added up on the bytes of a batch."""
    return _weight_sum(tuple(map(float, weights)), k)(F.col(seq))


@lru_cache(64)
def _weight_sum(weights: tuple[float, ...], k: int):
    table = np.array(weights[:-1])

    @F.arrow_udf(DoubleType())
    def total(column: pa.Array) -> pa.Array:
        row, number = S.kmer_codes(column, k)
        return pa.array(np.bincount(row, table[number], len(column)) + weights[-1], mask=column.is_null().to_numpy(zero_copy_only=False))

    return total


# ------------------------------------------------------------- mutagenesis


def single_substitutions(df: DataFrame, seq: str = "seq") -> DataFrame:
    """All 3 L candidates of each row: position from 0, then the other bases in order. Rows without a base have none."""
    return mutagenesis.with_candidates(df, seq, "_every").select(*df.columns, F.inline("_every"))


def flipped(seq: Column, position: Column, base: Column) -> Column:
    return F.concat(seq.substr(F.lit(1), position), base, seq.substr(position + 2, F.length(seq)))


#: A scorer as a column; one that adds up windows is searched by deltas, any other by all candidates.
Score = WindowScorer | Callable[[Column | str], Column]


def best_flip(df: DataFrame, score: Score, key: str = "pid", require_gain: bool = False) -> DataFrame:
    """The best candidate of each row; position, then base settle ties. Without ``require_gain`` it may be worse.

    Candidates of a foreign scorer are told apart by their score, place and base
    alone, so no more than that is aggregated.
    """
    if isinstance(score, WindowScorer):
        return mutagenesis.best_flip(df, score, require_gain)
    best = F.min(F.struct((-F.col("_v")).alias("v"), "position", "base")).alias("_b")
    found = single_substitutions(df.select(key, "seq")).withColumn("_v", score("candidate")).groupBy(key).agg(best)
    out = df.join(found.select(F.col(key).alias("_k"), "_b.*"), F.col(key) == F.col("_k")).drop("_k")
    out = out.withColumns({"candidate": flipped(F.col("seq"), F.col("position"), F.col("base")), "candidate_score": -F.col("v")}).drop("v")
    return out.where(F.col("candidate_score") > score("seq")) if require_gain else out


def hill_climb(df: DataFrame, score: Score, budget: int, length: int, cap: int | None = None, key: str = "pid") -> DataFrame:
    """``budget`` rounds of the best strictly better substitution within the edit cap; stops when no row improves.

    A row whose best flip breaks the cap wastes its round.
    """
    if isinstance(score, WindowScorer):
        return mutagenesis.hill_climb(df, score, budget, cap, key)
    now = df.select(key, "seq", F.col("seq").alias("origin"))
    for _ in range(budget):
        flips = best_flip(now, score, key, True).select(F.col(key).alias("_k"), "candidate")
        moved = now.join(flips, F.col(key) == F.col("_k"), "left")
        ok = F.col("candidate").isNotNull()
        if cap is not None:
            ok = ok & (S.hamming(F.coalesce("candidate", "seq"), "origin") <= cap)
        then = moved.withColumn("_moved", ok).withColumn("seq", F.when(ok, F.col("candidate")).otherwise(F.col("seq"))).select(key, "seq", "origin", "_moved")
        then = cut(then)
        done = then.where("_moved").isEmpty()
        now = then.drop("_moved")
        if done:
            break
    return now.withColumn("score", score("seq"))


def ism_trajectory(df: DataFrame, score: Score, generations: int, key: str = "pid") -> DataFrame:
    """Greedy mutagenesis: every generation applies the best flip, even if it lowers the score."""
    if isinstance(score, WindowScorer):
        return mutagenesis.ism_trajectory(df, score, generations, key)
    now = df.select(key, "seq").withColumns({"generation": F.lit(0), "score": score("seq"), "position": F.lit(None).cast("int"), "base": F.lit(None).cast("string")})
    out, first = now, now
    for g in range(1, generations + 1):
        step = best_flip(first.select(key, "seq"), score, key)
        first = step.select(key, F.col("candidate").alias("seq"), F.lit(g).alias("generation"), F.col("candidate_score").alias("score"), "position", "base")
        first = cut(first)
        out = out.unionByName(first)
    return out


def branch_tokens_climb(df: DataFrame, predict: Callable[[list[str]], np.ndarray], accept: Callable[[str], bool] | None = None, step_cap: int = 0, total_cap: int | None = None) -> DataFrame:
    """Hill climb over the bases that a row's branches propose: (pid, seq, score, swaps).

    Rows: pid, k, seq, parent, origin, score; the climb starts from the best
    branch (first k on ties). Positions where branches differ come by how many
    bases they show there, most first, left ones first on ties. At each one the
    other branches' bases are tried, and the best strictly better one stays,
    unless ``step_cap`` edits of the parent are made already or ``total_cap``
    edits of the origin would be passed. A row has a bounded number of
    branches, so its group is small; each rank's trials are scored in one call
    for all rows of a task's batch.
    """
    folded = df.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("k", "seq", "score"))).alias("b"), F.first("parent").alias("parent"), F.first("origin").alias("origin"))

    def differ(a: str, b: str) -> int:
        x, y = (np.frombuffer(t.encode("latin-1"), np.uint8) for t in (a, b))
        if len(x) != len(y):
            raise ValueError("sequences of one length")
        return int(np.count_nonzero(x != y))

    def climbed(rows):
        now, value, order, bases, swaps = [], [], [], [], [0] * len(rows)
        parents, origins = rows["parent"].tolist(), rows["origin"].tolist()
        # Edits of the parent and of the origin; a swap changes each by what it does at its place.
        steps, edits = [0] * len(rows), [0] * len(rows)
        for r, branches in enumerate(rows["b"]):
            best = max(branches, key=lambda r: (r["score"], -r["k"]))
            now.append(best["seq"]), value.append(best["score"])
            texts = [x["seq"] for x in branches]
            if len(set(map(len, texts))) > 1:
                raise ValueError("sequences of one length")
            grid = np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), -1)
            shown = {i: list(dict.fromkeys(t[i] for t in texts)) for i in np.flatnonzero((grid != grid[0]).any(0)).tolist()}
            order.append(sorted(shown, key=lambda i, shown=shown: (-len(shown[i]), i)))
            bases.append(shown)
            if step_cap:
                steps[r] = differ(best["seq"], parents[r])
            if total_cap is not None:
                edits[r] = differ(best["seq"], origins[r])
        for rank in range(max(map(len, order), default=0)):
            trials = []
            for r, places in enumerate(order):
                if rank >= len(places) or step_cap and steps[r] >= step_cap:
                    continue
                at, seq = places[rank], now[r]
                for base in bases[r][at]:
                    if base != seq[at]:
                        new = seq[:at] + base + seq[at + 1 :]
                        if accept is None or accept(new):
                            trials.append((r, new))
            if not trials:
                continue
            gained: dict[int, tuple[float, str]] = {}
            for (r, new), v in zip(trials, np.asarray(predict([x for _, x in trials]), float).tolist(), strict=True):
                if v > gained.get(r, (value[r], ""))[0]:
                    gained[r] = (v, new)
            for r, (v, new) in gained.items():
                at = order[r][rank]
                more = 0 if total_cap is None else (new[at] != origins[r][at]) - (now[r][at] != origins[r][at])
                if total_cap is None or edits[r] + more <= total_cap:
                    if step_cap:
                        steps[r] += (new[at] != parents[r][at]) - (now[r][at] != parents[r][at])
                    edits[r] += more
                    value[r], now[r] = v, new
                    swaps[r] += 1
        return rows[["pid"]].assign(seq=now, score=value, swaps=swaps)

    return folded.mapInPandas(lambda batches: map(climbed, batches), "pid long, seq string, score double, swaps long")


def tree_search(df: DataFrame, predict: Callable[[list[str]], np.ndarray], rounds: int, branches: int, rate: float, seed: int, explore: float = 1.4, depth: int = 10, mode: str = "ucb") -> DataFrame:
    """Tree search for each row, all rows of a batch side by side; the best node but the root is the result.

    Rows: pid, seq. A round goes down to a leaf of each tree, by UCB1 on the
    mean of the values below a node or, in mode ``uniform``, by breadth; adds
    ``branches`` mutated children to it, unless it is ``depth`` deep already;
    and hands the best child's score up. All trees' new nodes are scored in one
    call. The tree of a row never leaves its worker.
    """

    def descend(tree: dict) -> int:
        if mode == "uniform":  # the first node without children, by depth
            return next((i for i, k in enumerate(tree["kids"]) if not k and tree["depth"][i] < depth), -1)
        at = 0
        while tree["kids"][at]:
            logs, total, visits = math.log(tree["visits"][at]), tree["total"], tree["visits"]
            at = max(tree["kids"][at], key=lambda c: total[c] / visits[c] + explore * math.sqrt(logs / visits[c]))
        return at if tree["depth"][at] < depth else -1

    def run(batches):
        for batch in batches:
            seqs = batch["seq"].tolist()
            first = np.asarray(predict(seqs), float) if seqs else np.zeros(0)
            trees = [{"seq": [s], "up": [-1], "depth": [0], "visits": [1], "total": [float(v)], "score": [float(v)], "kids": [[]]} for s, v in zip(seqs, first, strict=True)]
            draws = [np.random.default_rng([seed, int(p)]) for p in batch["pid"]]
            for _ in range(rounds):
                news = []
                for r, tree in enumerate(trees):
                    at = descend(tree)
                    if at < 0:
                        continue
                    draw, parent = draws[r], np.frombuffer(tree["seq"][at].encode("latin-1"), np.uint8)
                    for _ in range(branches):
                        chars = parent.copy()
                        hit = np.flatnonzero(draw.random(len(chars)) < rate)
                        chars[hit] = _BASES[draw.integers(0, 4, len(hit))]
                        news.append((r, at, chars.tobytes().decode("latin-1")))
                if not news:
                    break
                top: dict[tuple[int, int], float] = {}
                for (r, at, new), v in zip(news, np.asarray(predict([x for _, _, x in news]), float).tolist(), strict=True):
                    tree = trees[r]
                    tree["kids"][at].append(len(tree["seq"]))
                    for name, value in (("seq", new), ("up", at), ("depth", tree["depth"][at] + 1), ("visits", 1), ("total", v), ("score", v), ("kids", [])):
                        tree[name].append(value)
                    top[r, at] = max(top.get((r, at), v), v)
                for (r, at), v in top.items():
                    while at >= 0:
                        trees[r]["visits"][at] += 1
                        trees[r]["total"][at] += v
                        at = trees[r]["up"][at]
            best = [max(range(1, len(t["seq"])), key=lambda i, t=t: (t["score"][i], -i), default=0) for t in trees]
            yield batch[["pid"]].assign(seq=[t["seq"][i] for t, i in zip(trees, best, strict=True)], score=[t["score"][i] for t, i in zip(trees, best, strict=True)])

    return df.select("pid", "seq").mapInPandas(run, "pid long, seq string, score double")
