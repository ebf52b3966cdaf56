"""k-mer profiles, population diagnostics and summaries."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from helixframe.functions import rng
from helixframe.functions import sequence as S
from helixframe.operators import ranking

EPSILON = 1e-10
# The reference correlation and its spread.
R_MEAN, R_SD = 0.51, 0.14
#: Rows whose profiles are counted together.
PROFILES = 4096


def dimension(spark, k: int = 3) -> DataFrame:
    """All 4^k k-mers: a fixed small side."""
    return spark.createDataFrame([("".join(p),) for p in product(S.BASES, repeat=k)], "kmer string")


def pool_profile(df: DataFrame, seq: str = "seq", k: int = 3, group: list[str] | None = None) -> DataFrame:
    """(group, kmer, n, share) over all rows; k-mers that don't occur count 0 only after a join with ``dimension``."""
    group = group or []
    n = kmer_counts(df, seq, k, group)
    total = n.groupBy(*group).agg(F.sum("n").alias("total"))
    if group:  # groups grow with the data: no broadcast is asked for
        same = [F.col(g).eqNullSafe(F.col(f"_t{i}")) for i, g in enumerate(group)]
        joined = n.join(total.select(*(F.col(g).alias(f"_t{i}") for i, g in enumerate(group)), "total"), same).drop(*(f"_t{i}" for i in range(len(group))))
    else:
        joined = n.join(F.broadcast(total), how="cross")
    return joined.withColumn("share", F.col("n") / F.col("total")).drop("total")


def kmer_counts(df: DataFrame, seq: str, k: int, group: list[str]) -> DataFrame:
    """(group, kmer, n): a batch's k-mers are counted as one array, so a task hands on a row for each group and k-mer of a batch."""
    rows = df.select(*group, F.col(seq).alias("_seq"))
    schema = StructType([*rows.select(*group).schema.fields, StructField("kmer", StringType()), StructField("n", LongType())])
    names = np.array(["".join(p) for p in product(S.BASES, repeat=k)])

    def run(batches):
        for batch in batches:
            keys = [batch.column(i) for i in range(len(group))]
            which = np.zeros(batch.num_rows, np.int64)
            if group:
                seen: dict[tuple, int] = {}
                codes = [np.asarray(c.dictionary_encode(null_encoding="encode").indices) for c in keys]
                rows_ = list(zip(*(c.tolist() for c in codes), strict=True))
                which = np.array([seen.setdefault(r, len(seen)) for r in rows_], np.int64)
                first = np.unique(which, return_index=True)[1]
            row, number = S.kmer_codes(batch.column("_seq"), k)
            n = np.bincount(which[row] * 4**k + number, minlength=(which.max() + 1) * 4**k if len(which) else 0)
            at = np.flatnonzero(n)
            out = [c.take(pa.array(first[at // 4**k])) for c in keys] if group else []
            yield pa.RecordBatch.from_arrays([*out, pa.array(names[at % 4**k], pa.string()), pa.array(n[at], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema).groupBy(*group, "kmer").agg(F.sum("n").alias("n"))


def sequence_profile(df: DataFrame, key: str = "pid", seq: str = "seq", k: int = 3) -> DataFrame:
    """(key, kmer, share) of the k-mers that occur.

    Rows meet by key as sequences, and a batch's k-mers are counted as one
    array; rows that share a key have one profile.
    """
    names = np.array(["".join(p) for p in product(S.BASES, repeat=k)])
    schema = StructType([df.select(key).schema[0], StructField("kmer", StringType()), StructField("share", DoubleType())])

    def told(keys: pa.Array, n: np.ndarray, most: np.ndarray):
        row, kmer = np.nonzero(n)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(names[kmer], pa.string()), pa.array(n[row, kmer] / (most[row] - (k - 1)))], schema.names)

    def run(batches):
        held = None  # the key at the end of a batch, whose rows may go on in the next
        for whole in batches:
            for at in range(0, whole.num_rows, PROFILES):
                batch = whole.slice(at, PROFILES)
                keys, column = batch.column(0), batch.column(1)
                same = pc.if_else(pc.is_null(keys), "", pc.cast(keys, pa.string())).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
                new = np.r_[True, (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])]
                group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
                row, number = S.kmer_codes(column, k)
                n = np.bincount(group[row] * 4**k + number, minlength=len(begin) * 4**k).reshape(-1, 4**k)
                most = np.maximum.reduceat(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), begin)
                firsts = keys.take(pa.array(begin))
                if held is not None:
                    if held[0][0].equals(firsts[0]):
                        n[0] += held[1][0]
                        most[0] = max(most[0], held[2][0])
                    else:
                        yield told(*held)
                held = firsts.slice(len(begin) - 1), n[-1:], most[-1:]
                yield told(firsts.slice(0, len(begin) - 1), n[:-1], most[:-1])
        if held is not None:
            yield told(*held)

    return df.select(key, seq).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def correlation_with(df: DataFrame, reference: DataFrame, key: str = "pid", seq: str = "seq", k: int = 3) -> DataFrame:
    """(key, r, z): correlation with a reference profile (kmer, share) over all 4^k cells; no variance gives r = 0.

    The profile is a fixed number of shares, which every task gets; a row's r
    needs no other row.
    """
    share = {r["kmer"]: r["share"] for r in reference.select("kmer", "share").limit(4**k).collect()}
    y = np.array([share.get("".join(p), 0.0) for p in product(S.BASES, repeat=k)])
    syy = float((y * y).sum() - y.sum() * y.mean())

    @F.arrow_udf(DoubleType())
    def r(column: pa.Array) -> pa.Array:
        row, number = S.kmer_codes(column, k)
        n = np.bincount(row * 4**k + number, minlength=len(column) * 4**k).reshape(len(column), -1)
        total = n.sum(1)
        bottom = np.sqrt(np.maximum((n * n).sum(1) - total * total / 4**k, 0) * syy)
        return pa.array(np.where(bottom > 0, (n @ y - total * y.mean()) / np.where(bottom > 0, bottom, 1), 0.0))

    return df.select(key, r(F.col(seq)).alias("r")).withColumn("z", (F.col("r") - R_MEAN) / R_SD)


def divergence(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Pearson r and KL(a || b) of two pool profiles over all k-mers; one row."""
    dim = dimension(a.sparkSession, k)
    both = dim.join(a.select("kmer", F.col("share").alias("p")), "kmer", "left").join(b.select("kmer", F.col("share").alias("q")), "kmer", "left").na.fill(0.0, ["p", "q"])
    return both.agg(F.coalesce(F.corr("p", "q"), F.lit(0.0)).alias("pearson"), F.sum(F.col("p") * F.log((F.col("p") + EPSILON) / (F.col("q") + EPSILON))).alias("kl"))


def position_counts(df: DataFrame, seq: str = "seq", group: list[str] | None = None) -> DataFrame:
    """(group, position, base, n): rows leave a task already counted."""
    group = group or []
    rows = df.select(*group, F.posexplode(F.split(seq, "")).alias("position", "base"))
    return rows.groupBy(*group, "position", "base").agg(F.count(F.lit(1)).alias("n"))


def consensus(df: DataFrame, seq: str = "seq", group: list[str] | None = None) -> DataFrame:
    """The commonest base of each position; the first in the alphabet on ties."""
    group = group or []
    best = F.min_by("base", F.struct((-F.col("n")).alias("n"), "base"))
    return position_counts(df, seq, group).groupBy(*group, "position").agg(best.alias("base"), F.max("n").alias("n"))


def consensus_string(df: DataFrame, seq: str = "seq", group: list[str] | None = None) -> DataFrame:
    """The consensus as a string: one row, or one a group."""
    group = group or []
    bases = F.transform(F.array_sort(F.collect_list(F.struct("position", "base"))), lambda x: x["base"])
    return consensus(df, seq, group).groupBy(*group).agg(F.array_join(bases, "").alias("consensus"))


def conformity(df: DataFrame, seq: str = "seq", group: str | None = None) -> DataFrame:
    """Adds ``conformity``: the share of positions that equal the consensus of all rows, or of the row's group; null for rows without a group."""
    share = 1.0 - S.hamming(seq, "consensus") / F.length(seq)
    if not group:
        return df.join(F.broadcast(consensus_string(df, seq)), how="cross").withColumn("conformity", share).drop("consensus")
    told = consensus_string(df.where(F.col(group).isNotNull()), seq, [group]).withColumnRenamed(group, "_g")
    return df.join(told, F.col(group) == F.col("_g"), "left").withColumn("conformity", share).drop("consensus", "_g")


def mean_distance(df: DataFrame, key: str = "pid", seq: str = "seq") -> DataFrame:
    """(key, seq, mean_distance): the mean Hamming distance of each row to all rows, itself included.

    In closed form: at each place, the share of rows with another base. The
    counts are four figures a place, whatever the number of rows; sequences are
    of one length.
    """
    counts = position_counts(df, seq).collect()
    n, length = sum(r["n"] for r in counts if r["position"] == 0), 1 + max((r["position"] for r in counts), default=-1)
    others = np.full((length, 256), n, np.int64)
    for r in counts:
        if r["base"]:
            others[r["position"], ord(r["base"])] = n - r["n"]

    @F.arrow_udf(DoubleType())
    def distance(column: pa.Array) -> pa.Array:
        body, offsets = S._joined(column)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        place = np.arange(len(body)) - offsets[row]
        total = np.zeros(len(column), np.int64)
        np.add.at(total, row, others[np.minimum(place, length - 1), body])
        return pa.array(total / max(n, 1), mask=column.is_null().to_numpy(zero_copy_only=False))

    return df.select(key, seq, distance(F.col(seq)).alias("mean_distance"))


def pairwise_identity(df: DataFrame, seq: str = "seq", group: list[str] | None = None) -> DataFrame:
    """Mean identity over all pairs, exact from position counts, without a self-join."""
    group = group or []
    same = position_counts(df, seq, group).groupBy(*group).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("_same"))
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(seq)).alias("_l"))
    joined = same.join(size, group) if group else same.join(size, how="cross")
    pairs = F.col("n") * (F.col("n") - 1) / 2 * F.col("_l")
    return joined.select(*group, "n", F.when(F.col("n") > 1, F.col("_same") / F.nullif(pairs, F.lit(0.0))).otherwise(1.0).alias("identity"))


def summary(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Mean, maximum, population deviation and 99th percentile (linear)."""
    by = [group] if group else []
    told = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))
    top = ranking.quantiles(df, value, {"p99": 0.99}, group)
    return told.join(top, by) if group else told.join(F.broadcast(top), how="cross")


def ranges(df: DataFrame, columns: list[str], n: int, key: str, seed: int) -> DataFrame:
    """(cell, min, max, mean) of each column on n rows drawn by hash."""
    drawn = df.orderBy(rng.order_key(seed, key), key).limit(n).select(*columns)
    one = drawn.agg(*(f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cell"), *(F.col(f"{c}_{x}").alias(x) for x in ("min", "max", "mean"))) for c in columns))).alias("r")).select("r.*")


def last_generation(df: DataFrame, score: str, edits: str, step: str = "generation") -> DataFrame:
    """One row: n, mean and largest score, its sample deviation and the mean edits, over the rows of the last generation."""
    last = df.agg(F.max(step).alias("_last"))
    rows = df.join(F.broadcast(last), F.col(step) == F.col("_last"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.max(score).alias("max"), F.stddev_samp(score).alias("std"), F.avg(edits).alias("edits"))


def effective_size(df: DataFrame, log_weight: str, group: list[str] | None = None) -> DataFrame:
    """ESS and log-mean-exp in two passes, shifted by the largest log-weight."""
    group = group or []
    top = df.groupBy(*group).agg(F.max(log_weight).alias("_m"))
    rows = df.join(F.broadcast(top), group) if group else df.join(F.broadcast(top), how="cross")
    w = F.exp(F.col(log_weight) - F.col("_m"))
    out = rows.groupBy(*group).agg(F.sum(w).alias("_s"), F.sum(w * w).alias("_q"), F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"))
    ess = F.when(F.col("_s") < 1e-300, 0.0).otherwise(F.col("_s") * F.col("_s") / F.col("_q"))
    return out.select(*group, "n", ess.alias("ess"), (F.col("_m") + F.log(F.col("_s") / F.col("n"))).alias("log_mean_exp"))


def agreement(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Pearson r, Spearman rho (of average ranks), mean squared error and n per group; no group is in one task."""
    ranked = ranking.with_average_rank(ranking.with_average_rank(df.select(group, a, b), a, "_ra", group), b, "_rb", group)
    return ranked.groupBy(group).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.avg((F.col(a) - F.col(b)) ** 2).alias("mse"), F.count(F.lit(1)).alias("n"))


def lagrange_step(multiplier: float, mean_gc: float, target: float, tolerance: float, rate: float) -> float:
    """The multiplier after one step on |mean gc - target| - tolerance, never below 0."""
    return max(0.0, multiplier + rate * (abs(mean_gc - target) - tolerance))
