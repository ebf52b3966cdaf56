"""Reweighting and resampling of a population."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.functions import rng
from helixframe.functions import sequence as S
from helixframe.functions.lineage import cut
from helixframe.operators import profiles
from helixframe.operators.ranking import prefix_sum
from helixframe.operators.relational import numbered, range_parts, sample_with_replacement

#: Candidate steps to a round of the search, and rounds: 2 ** -48 of the range is told apart.
WIDTH, ROUNDS = 256, 6
#: Bins over the range of the fitness, and powers kept of the distance to a bin's middle.
BINS, POWERS = 1024, 9


class _WeightSums:
    """The sums of weights and of their squares, as functions of the temperature step.

    Made from rows that are summed by bins of their fitness: for a step ``at``,
    each bin has the sums of weight times (fitness - middle)^j. Another step
    follows from these by the series of the exponential, which is exact to
    rounding while the change times half a bin is small. Sums of bins merge by
    addition, so a task hands on a row a bin at most.
    """

    def __init__(self, df: DataFrame, fitness: str, log_weight: str | None, at: float, top: float, low: float, start: float, count: str | None = None):
        self.at, self.half = at, (top - low) / BINS / 2
        place = F.least(F.floor((F.col(fitness) - F.lit(low)) / F.lit(2 * self.half)), F.lit(BINS - 1)).cast("int")
        w = F.exp((F.lit(0.0) if log_weight is None else F.col(log_weight) - F.lit(start)) + F.lit(at) * (F.col(fitness) - F.lit(top)))
        rows = df.where(F.col(fitness).isNotNull()).select(place.alias("bin"), w.alias("w"), (F.col(fitness) - F.lit(low)).alias("x"), (F.col(count) if count else F.lit(1.0)).alias("c"))
        rows = rows.select("bin", "w", "c", (F.col("x") - (F.col("bin") + 0.5) * F.lit(2 * self.half)).alias("x"))
        power = lambda j: F.lit(1.0) if j == 0 else F.pow("x", F.lit(float(j)))
        sums = rows.groupBy("bin").agg(*(F.sum(F.col("c") * F.col("w") * power(j)).alias(f"s{j}") for j in range(POWERS)), *(F.sum(F.col("c") * F.col("w") * F.col("w") * power(j)).alias(f"q{j}") for j in range(POWERS)))
        got = sums.orderBy("bin").collect()
        self.middle = low - top + (np.array([r["bin"] for r in got]) + 0.5) * 2 * self.half
        self.s, self.q = (np.array([[r[f"{c}{j}"] for j in range(POWERS)] for r in got]) for c in "sq")

    def near(self, step: float) -> bool:
        return 2 * abs(step - self.at) * self.half <= 0.05

    def effective(self, step: float) -> float:
        """(sum of weights)^2 / sum of squares."""
        change, out = step - self.at, []
        for sums, c in ((self.s, change), (self.q, 2 * change)):
            # Far from the step that was summed, a bin counts by its middle alone: rough, and summed anew before it is believed.
            powers = POWERS if abs(c) * self.half <= 1 else 1
            series = sum(sums[:, j] * c**j / math.factorial(j) for j in range(powers))
            out.append(float((np.exp(np.clip(c * self.middle, -700, 700)) * series).sum()))
        return 0.0 if out[0] < 1e-300 or out[1] <= 0 else out[0] ** 2 / out[1]


def largest_step(df: DataFrame, fitness: str, remaining: float, share: float, log_weight: str | None = None, count: str | None = None) -> float:
    """The largest temperature step up to ``remaining`` whose effective size is ``share`` of the rows at least.

    One job sums the rows by bins; every round of the search lays ``WIDTH``
    candidates over the range that is left and reads them off the sums. If the
    answer is far from the step that the sums were made for, they are made anew
    there, mostly once. The same search serves any number of rows. ``count``: a
    column that tells how many rows a row stands for.
    """
    told = df.agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"), F.max(fitness).alias("top"), F.min(fitness).alias("low"), F.max(log_weight or F.lit(0.0)).alias("lw")).first()
    if told["top"] is None or (told["top"] == told["low"] and log_weight is None):
        return remaining
    wanted, at = share * told["n"], 0.0
    spread = float(told["top"]) - float(told["low"]) or 1.0
    for _ in range(8):
        sums = _WeightSums(df, fitness, log_weight, at, float(told["top"]), float(told["top"]) - spread, told["lw"], count)
        found = searched(sums, remaining, wanted)
        if sums.near(found):
            break
        at = found
    return found


def searched(sums, remaining: float, wanted: float) -> float:
    """The largest step whose effective size, as ``sums`` tells it, is ``wanted`` at least."""
    low, high = 0.0, remaining
    for _ in range(ROUNDS):
        steps = [low + (high - low) * (i + 1) / WIDTH for i in range(WIDTH)]
        best = next((i for i in reversed(range(WIDTH)) if sums.effective(steps[i]) >= wanted), None)
        if best == WIDTH - 1:
            return high
        low, high = (low if best is None else steps[best]), steps[0 if best is None else best + 1]
    return low


def fixed_point(df: DataFrame, weight: str, name: str) -> DataFrame:
    """Adds the weight as a whole number whose sum over all rows fits a long: sums are the same in any order."""
    told = df.agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("top")).first()
    if dict(df.dtypes)[weight] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(name, F.col(weight).cast("long"))
    unit = float((1 << 62) // max(told["n"], 1)) / (told["top"] or 1.0)
    return df.withColumn(name, F.floor(F.col(weight) * unit).cast("long"))


def _points(upto: Column, total: Column, n: Column, u0: float) -> Column:
    """The number of the last of n evenly spaced points that falls on or before ``upto``; -1 for none."""
    return F.when(upto <= 0, F.lit(-1)).when(upto >= total, n - 1).otherwise(F.least(F.floor(n * (upto / total) - F.lit(u0)), n - 1))


def systematic_copies(df: DataFrame, weight: str, key: str, u0: float, n: int | None = None, group: str | None = None) -> DataFrame:
    """Adds ``copies``: how many of n evenly spaced points fall to each row, in the order of ``key``.

    u0 in [0, 1) is where in its step each point lies. With a ``group`` each
    group has points of its own, as many as it has rows if n isn't given.
    Running sums are taken over ranges of the table, so that neither the table
    nor a large group is in one task; they are of whole numbers, so that the
    copies add up to n.
    """
    rows = prefix_sum(fixed_point(df, weight, "_w"), key, "_w", "_cum", group)
    by = [group] if group else []
    total = rows.groupBy(*by).agg(F.sum("_w").alias("_all"), (F.count(F.lit(1)) if n is None else F.lit(n)).alias("_n"))
    rows = rows.join(total, group) if group else rows.join(F.broadcast(total), how="cross")
    here, prior = (_points(c, F.col("_all"), F.col("_n"), u0) for c in (F.col("_cum"), F.col("_cum") - F.col("_w")))
    return rows.withColumn("copies", F.greatest(here - prior, F.lit(0)).cast("long")).drop("_cum", "_all", "_n", "_w")


def expand(df: DataFrame, key: str = "pid") -> DataFrame:
    """One row per copy; ``copy`` numbers them from 1."""
    return df.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def tempered(df: DataFrame, log_weight: str, temperature: float | Column) -> DataFrame:
    """Weights of log-weights divided by a temperature over 1, a number or a column."""
    top = df.agg(F.max(log_weight).alias("_m"))
    heat = F.greatest(F.lit(1.0), temperature if isinstance(temperature, Column) else F.lit(float(temperature)))
    return df.join(F.broadcast(top), how="cross").withColumn("weight", F.exp((F.col(log_weight) - F.col("_m")) / heat)).drop("_m")


def weighted_draws(df: DataFrame, n: int, weight: str, key: str, seed: int, stream: str = "weighted") -> DataFrame:
    """(draw, key): n independent draws with replacement, each row with the chance of its weight; rows of weight 0 never come.

    Each draw is a whole number below the sum of the weights and goes to the
    first row, by key, whose running sum is beyond it. Draws and running sums
    are dealt over the same ranges, so the search is a window in each range; a
    range's draws beyond its last row go to the first row of a later one.
    """
    rows = prefix_sum(fixed_point(df.select(key, weight).where(F.col(weight) > 0), weight, "_w"), key, "_w", "_upto")
    total = rows.agg(F.max("_upto")).first()[0]
    if not total or n <= 0:
        return df.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    half = lambda s: F.floor(rng.uniform(seed, s, "draw") * F.lit(4294967296.0)).cast("long")
    point = F.pmod(F.floor(half(f"{stream}-high") / 2).cast("long") * F.lit(1 << 32) + half(f"{stream}-low"), F.lit(total))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_x", point)
    # A row stands just before the first point that is no longer its own.
    both = rows.select((F.col("_upto") - 1).alias("_x"), F.lit(None).cast("long").alias("draw"), F.struct(key).alias("_r")).unionByName(draws.withColumn("_r", F.lit(None).cast(f"struct<{key}:{dict(df.dtypes)[key]}>")))
    parts = range_parts(both.withColumn("_o", F.struct("_x", F.col("_r").isNotNull().alias("row"), "draw")), "_o")
    # Backwards, so that the frame only grows: one that shrinks is gone through anew for every row.
    ahead = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("_r", F.last("_r", ignorenulls=True).over(ahead)).where("draw is not null")
    # One row a range: its first row, for the draws that end the ranges before it.
    first = {r["_part"]: r["f"] for r in parts.where("_r is not null").groupBy("_part").agg(F.min_by("_r", "_at").alias("f")).collect()}
    side, after = [], None
    for p in range(max(first), -1, -1):
        side.append((p, after))
        after = first.get(p, after)
    side = df.sparkSession.createDataFrame(side, f"_part int, _n struct<{key}:{dict(df.dtypes)[key]}>")
    return found.join(F.broadcast(side), "_part", "left").select("draw", F.coalesce("_r", "_n")[key].alias(key))


def capped(df: DataFrame, most: int, weight: str, key: str, seed: int) -> DataFrame:
    """At most ``most`` copies each; what is lost is drawn with replacement among rows that have copies.

    Rows under the cap are drawn by weight, or if there are none, all rows
    alike; the draws are independent. They may lift a row above the cap again.
    """
    kept = df.withColumn("copies", F.least(F.col("copies"), F.lit(most)))
    lost = df.agg(F.sum(F.greatest(F.col("copies") - most, F.lit(0)))).first()[0] or 0
    if not lost:
        return kept
    low = kept.where((F.col("copies") > 0) & (F.col("copies") < most)).select(key, weight)
    if low.isEmpty():
        low = kept.where("copies > 0").select(key, F.lit(1).alias(weight))
    extra = weighted_draws(low, int(lost), weight, key, seed, "fill").groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_x"))
    return kept.join(extra, F.col(key) == F.col("_k"), "left").withColumn("copies", F.col("copies") + F.coalesce("_x", F.lit(0))).drop("_k", "_x")


def rng_start(seed: int) -> float:
    return float(np.random.default_rng(seed).random())


# ------------------------------------------------------- stratified resampling


def bins(value: str, edges: list[float]):
    """Bin numbers: the top edge falls in the last bin, values outside in the end bins."""
    upto = sum((F.col(value) >= e).cast("int") for e in edges[1:]) + (F.col(value) >= edges[0]).cast("int")
    return F.least(F.greatest(upto - 1, F.lit(0)), F.lit(len(edges) - 2))


def every_bin(df: DataFrame, edges: list[float]) -> DataFrame:
    """The rows of ``df`` by ``bin``, and a row for each bin that it lacks."""
    return df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(df, "bin", "left")


def bin_summary(df: DataFrame, value: str, score: str, edges: list[float]) -> DataFrame:
    """(bin, n, mean) of every bin, empty ones too."""
    got = df.withColumn("bin", bins(value, edges)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"))
    return every_bin(got, edges).na.fill({"n": 0, "mean": 0.0})


#: What a bin's share follows, by mode, from (mean, least mean, mean of means) over the bins with rows.
SHARES = {
    "raw": lambda mean, low, middle, alpha: F.greatest(mean, F.lit(0.0)),
    "minshift": lambda mean, low, middle, alpha: mean - low,
    "exp": lambda mean, low, middle, alpha: F.exp(alpha * (mean - middle)),
}


def allotted(summary: DataFrame, n: int, mode: str = "raw", alpha: float = 1.0, least: int = 0) -> DataFrame:
    """Adds ``quota``, the rows to draw from each bin of ``bin_summary``, as DataFrame steps over its few rows.

    Each bin gets ``least`` and its share of what is left, rounded half to even;
    the first bin of the largest share takes the difference to n. Bins without
    rows have no share; if no bin has one, all have the same.
    """
    every = Window.partitionBy(F.lit(0))
    full = F.when(F.col("n") > 0, F.col("mean"))
    weigh = SHARES[mode](F.col("mean"), F.min(full).over(every), F.avg(full).over(every), alpha)
    bins_ = summary.withColumns({"_s": F.when(F.col("n") > 0, weigh).otherwise(0.0), "_nb": F.count(F.lit(1)).over(every)})
    whole = F.sum("_s").over(every)
    bins_ = bins_.withColumn("_s", F.when(whole > 0, F.col("_s") / whole).otherwise(1.0 / F.col("_nb")))
    spare = n - least * F.col("_nb")
    bins_ = bins_.withColumn("_q", (least + F.bround(F.col("_s") * spare)).cast("long"))
    first = F.row_number().over(every.orderBy(F.desc("_s"), "bin")) == 1
    quota = F.col("_q") + F.when(first, n - F.sum("_q").over(every)).otherwise(0)
    return bins_.withColumn("quota", F.when(spare <= 0, F.floor(n / F.col("_nb"))).otherwise(quota).cast("long")).drop("_s", "_nb", "_q")


def stratified_copies(df: DataFrame, weight: str, key: str, value: str, score: str, edges: list[float], n: int, u0: float = 0.5, mode: str = "raw", alpha: float = 1.0, least: int = 0) -> DataFrame:
    """Adds ``bin`` and ``copies``: systematic draws of each bin's quota; u0 is a share of the step.

    What empty bins leave short is drawn from the whole table. The rows are
    computed once, and a bin's running sums go over ranges.
    """
    rows = prefix_sum(fixed_point(df.withColumn("bin", bins(value, edges)), weight, "_w"), key, "_w", "_c", "bin")
    sums = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.sum("_w").alias("_t"))
    told = cut(allotted(every_bin(sums, edges).na.fill({"n": 0, "mean": 0.0}), n, mode, alpha, least))
    joined = rows.join(F.broadcast(told.select("bin", "quota", "_t")), "bin")
    here, prior = (_points(c, F.col("_t"), F.col("quota"), u0) for c in (F.col("_c"), F.col("_c") - F.col("_w")))
    out = joined.withColumn("copies", F.when(F.col("quota") > 0, F.greatest(here - prior, F.lit(0))).otherwise(0).cast("long")).drop("quota", "_c", "_t", "_w")
    short = told.where("n = 0").agg(F.sum("quota")).first()[0] or 0
    if short > 0:
        extra = systematic_copies(out.select(key, weight), weight, key, u0, int(short)).select(F.col(key).alias("_k"), F.col("copies").alias("_x"))
        out = out.join(extra, F.col(key) == F.col("_k")).withColumn("copies", F.col("copies") + F.col("_x")).drop("_k", "_x")
    return out


def swap_map(best: list[tuple[int, float, float]], temperatures: list[float], beta: float, draws: list[float]) -> list[tuple[int, int]]:
    """Accepted swaps of neighbouring islands: (pid, pid) pairs.

    best: (pid, fitness, ...) of one row of each island, hottest last.
    """
    out = []
    for i in range(len(best) - 1):
        cold, hot = best[i], best[i + 1]
        gain = (beta / temperatures[i] - beta / temperatures[i + 1]) * (hot[1] - cold[1])
        if math.log(draws[i] + 1e-30) < gain:
            out.append((cold[0], hot[0]))
    return out


def swapped(df: DataFrame, pairs: list[tuple[int, int]], key: str = "pid", island: str = "island", stay: tuple[str, ...] = ("origin",)) -> DataFrame:
    """Rows of the pairs change islands and keys; the columns of ``stay`` (the ancestor) remain with the place, as they aren't part of the exchange."""
    if not pairs:
        return df
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    side = df.sparkSession.createDataFrame(both, "_a long, _b long")
    stay = [c for c in stay if c in df.columns]
    target = df.select(F.col(key).alias("_b"), F.col(island).alias("_to"), *(F.col(c).alias(f"_stay_{c}") for c in stay))
    # Two rows a pair of islands.
    moves = F.broadcast(side.join(target, "_b").select("_a", "_to", F.col("_b").alias("_key"), *(f"_stay_{c}" for c in stay)))
    out = df.join(moves, F.col(key) == F.col("_a"), "left")
    out = out.withColumns({c: F.when(F.col("_key").isNotNull(), F.col(f"_stay_{c}")).otherwise(F.col(c)) for c in stay}) if stay else out
    return out.withColumns({island: F.coalesce("_to", island), key: F.coalesce("_key", key)}).select(*df.columns)


def rejuvenated(df: DataFrame, fresh: DataFrame, share: float, fitness: str, key: str = "pid") -> DataFrame:
    """The lowest max(1, int(share n)) rows take sequences from ``fresh`` (slot, seq); their ancestor starts anew.

    Where ``fresh`` has an ``origin`` it becomes the ancestor (a sequence that was
    mutated since it was drawn). Both sides grow with the population, so they meet by shuffle.
    """
    order = numbered(df.withColumn("_o", F.struct(fitness, key)), "_o", "_slot").drop("_o")
    k = max(1, int(share * order.count()))
    start = F.col("origin") if "origin" in fresh.columns else F.col("seq")
    new = fresh.where(F.col("slot") < k).select(F.col("slot").alias("_slot"), F.col("seq").alias("_new"), start.alias("_start"), (F.col(fitness) if fitness in fresh.columns else F.lit(None)).alias("_fit"))
    out = order.join(new, "_slot", "left")
    return out.withColumns({"seq": F.coalesce("_new", "seq"), "origin": F.coalesce("_start", "origin"), fitness: F.coalesce("_fit", fitness)}).drop("_slot", "_new", "_start", "_fit")


def diverse_source(df: DataFrame, n: int, key: str = "pid") -> DataFrame:
    """(slot, seq): the n rows of the largest mean distance to the whole population, the smallest key on ties."""
    far = profiles.mean_distance(df.select(key, "seq"), key).orderBy(F.desc("mean_distance"), key).limit(n)
    return numbered(far.withColumn("_o", F.struct((-F.col("mean_distance")).alias("d"), key)), "_o", "slot").select("slot", "seq")


def pool_source(pool: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """(slot, seq): n draws with replacement from a pool of seeds."""
    return sample_with_replacement(pool.select(key, "seq"), n, key, seed).select(F.col("draw").alias("slot"), "seq")


def uniform_source(spark, n: int, length: int, seed: int, stream: str = "src") -> DataFrame:
    """n random sequences by the hash PRNG: (slot, seq)."""
    base = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.substring(F.lit("ACGT"), (F.floor(rng.uniform(seed, stream, F.col("id"), i) * 4) + 1).cast("int"), F.lit(1)))
    return spark.range(n).select(F.col("id").alias("slot"), F.array_join(base, "").alias("seq"))


def uniform_rows(df: DataFrame, key: str, length: Column, seed: int, stream: str = "rows") -> DataFrame:
    """``df`` with a random sequence of its own ``length`` for each row, by the hash PRNG."""
    base = lambda i: F.substring(F.lit(S.BASES), (F.floor(rng.uniform(seed, stream, key, i) * 4) + 1).cast("int"), F.lit(1))
    places = F.when(length > 0, F.sequence(F.lit(0), length.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("seq", F.array_join(F.transform(places, base), ""))


def gc_rejected_rows(df: DataFrame, key: str, bin_col: str, length: int, edges: list[float], seed: int, attempts: int = 100) -> DataFrame:
    """``df`` with a random sequence for each row whose GC share lies in the row's bin, the top edge left out.

    Uniform sequences are drawn until one fits, two bits a base of
    md5(seed:balanced:key:attempt:block). A row that none of ``attempts`` fits
    repeats the sequence of the smallest key of its bin that has one; if the bin
    has none, it stays null. Each row is drawn where it is.
    """
    blocks = -(-length // 64)

    @F.arrow_udf(StringType())
    def drawn(keys: pa.Array, which: pa.Array) -> pa.Array:
        names, out = keys.to_pylist(), [None] * len(keys)
        low, high = (np.array([edges[b + k] if b is not None and 0 <= b < len(edges) - 1 else np.nan for b in which.to_pylist()]) for k in (0, 1))
        left = np.flatnonzero(~np.isnan(low))
        for t in range(attempts):
            if not len(left):
                break
            raw = b"".join(hashlib.md5(f"{seed}:balanced:{names[i]}:{t}:{b}".encode()).digest() for i in left.tolist() for b in range(blocks))
            two = np.frombuffer(raw, np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
            codes = two.reshape(len(left), -1)[:, :length]
            share = ((codes == 1) | (codes == 2)).sum(1) / length
            fits = (share >= low[left]) & (share < high[left])
            for i, c in zip(left[fits].tolist(), np.frombuffer(S.BASES.encode(), np.uint8)[codes[fits]], strict=True):
                out[i] = c.tobytes().decode()
            left = left[~fits]
        return pa.array(out, pa.string())

    rows = cut(df.withColumn("seq", drawn(F.col(key).cast("string"), F.col(bin_col).cast("int"))))
    # A row a bin.
    first = F.broadcast(rows.where("seq is not null").groupBy(F.col(bin_col).alias("_b")).agg(F.min_by("seq", key).alias("_s")))
    return rows.join(first, F.col(bin_col) == F.col("_b"), "left").withColumn("seq", F.coalesce("seq", "_s")).drop("_b", "_s")


def gc_balanced_source(spark, n: int, length: int, edges: list[float], seed: int, oversample: int = 4) -> DataFrame:
    """n random sequences spread evenly over GC bins: candidates by the PRNG, a quota of each bin.

    Bins are hit by candidates whose GC probability sweeps the range, so that
    outer bins fill too; a bin that stays short is filled by repeating its own.
    """
    nb = len(edges) - 1
    quota = [n // nb + (i < n % nb) for i in range(nb)]
    p = (F.lit(edges[0]) + (F.col("id") % 64 + 0.5) / 64.0 * (edges[-1] - edges[0])).alias("p")
    pool = spark.range(n * oversample * 2).select("id", p)
    pick = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.when(rng.uniform(seed, "gc", F.col("id"), i) < F.col("p"), F.when(rng.uniform(seed, "cg", F.col("id"), i) < 0.5, "C").otherwise("G")).otherwise(
            F.when(rng.uniform(seed, "at", F.col("id"), i) < 0.5, "A").otherwise("T")
        ),
    )
    from helixframe.functions.sequence import gc

    rows = pool.withColumn("seq", F.array_join(pick, "")).withColumn("gc", gc("seq")).where(F.col("gc").between(edges[0], edges[-1])).withColumn("bin", bins("gc", edges))
    side = F.broadcast(spark.createDataFrame(list(enumerate(quota)), "bin int, _q long"))
    order = Window.partitionBy("bin").orderBy(rng.order_key(seed, "id"), "id")
    ranked = rows.join(side, "bin").withColumns({"_n": F.row_number().over(order) - 1, "_have": F.count(F.lit(1)).over(Window.partitionBy("bin"))})
    taken = ranked.where(F.col("_n") < F.col("_q"))
    times = F.when(F.col("_have") < F.col("_q"), F.ceil((F.col("_q") - F.col("_n")) / F.col("_have"))).otherwise(1).cast("int")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), times))).select("bin", "id", "again", "seq", "gc")
