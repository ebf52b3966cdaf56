"""Filters, joins, top-k and set operations over populations.

Every order has a last key that is unique, so ties are settled the same way
whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import rng
from helixframe.functions import sequence as S
from helixframe.functions.lineage import cut

FILTERS = ("gc", "entropy", "cpg", "symmetry", "homopolymer")


def filter_mask(seq: str = "seq", low: float = 0.40, high: float = 0.70) -> dict[str, Column]:
    """The five plausibility filters, with their exact bounds."""
    return {
        "gc": S.gc(seq).between(low, high),
        "entropy": S.entropy(seq) >= 1.9,
        "cpg": S.cpg(seq) <= 0.072,
        "symmetry": (S.asymmetry(seq, "A", "T") < 0.15) & (S.asymmetry(seq, "G", "C") < 0.15),
        "homopolymer": S.homopolymer(seq) <= 12,
    }


def with_mask(df: DataFrame, seq: str = "seq") -> DataFrame:
    mask = filter_mask(seq)
    out = df.withColumns({f"ok_{k}": v for k, v in mask.items()})
    return out.withColumn("ok", F.expr(" and ".join(f"ok_{k}" for k in mask)))


def filter_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that pass each filter on its own, and all of them: one aggregation."""
    masked = with_mask(df, seq)
    return masked.agg(F.count(F.lit(1)).alias("n_all"), *(F.count_if(f"ok_{k}").alias(f"n_{k}") for k in FILTERS), F.count_if("ok").alias("n_ok"))


def accept_or_revert(ok: Column, new: Column, parent: Column) -> Column:
    """A proposal that fails keeps its parent; the row count stays."""
    return F.when(ok, new).otherwise(parent)


def within_edit_caps(new: Column, origin: Column, parent: Column, length: int, total_share: float | None = None, step_cap: int | None = None) -> Column:
    ok = F.lit(True)
    if total_share is not None:
        ok = ok & (S.hamming(new, origin) <= int(total_share * length))
    if step_cap is not None:
        ok = ok & (S.hamming(new, parent) <= step_cap)
    return ok


def finite_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two values are finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(ok(a) & ok(b))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with neither a null nor a NaN in ``columns``."""
    out = df.dropna(subset=columns)
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] in ("double", "float"):
            out = out.where(~F.isnan(c))
    return out


def require_known_orientation(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``orientation``; a row with neither adapter raises when read."""
    where = S.orientation(seq)
    return df.withColumn("orientation", F.when(where.isNull(), F.raise_error(F.lit("no known adapter leads a row"))).otherwise(where))


#: Names of splits and the flags that tell them.
SPLITS = {"train": "is_train", "val": "is_val", "test": "is_test"}


def of_split(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split, by its flag."""
    return df.where(F.col(SPLITS[split]))


def forward_only(df: DataFrame, flag: str = "rev") -> DataFrame:
    """Rows that aren't reversed; a table without the flag has no other."""
    return df.where(F.col(flag) == 0) if flag in df.columns else df


def of_seed_type(df: DataFrame, kind: str, column: str = "seed_type") -> DataFrame:
    """Rows of one kind of seed; ``both`` lets all pass."""
    return df if kind == "both" else df.where(F.col(column) == kind)


def head(df: DataFrame, n: int, index: str) -> DataFrame:
    """The rows numbered below n, in the order that ``index`` gives."""
    return df.where(F.col(index) < n)


# ------------------------------------------------------------------- joins


def backfilled(seeds: DataFrame, labels: DataFrame, on: str, value: str, scored: Column) -> DataFrame:
    """Left join that keeps duplicates; where the label is missing, the score stands in."""
    joined = seeds.join(labels.select(on, value), on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), scored))


def memo_misses(wanted: DataFrame, memo: DataFrame, on: str) -> DataFrame:
    """Distinct keys that the memo has no score for."""
    return wanted.select(on).distinct().join(memo, on, "left_anti")


#: Rows of a query set that distances are taken to, and rows that are compared with all of it at once.
QUERY_ROWS, BLOCK_ROWS = 10_000, 512


def distances_to(df: DataFrame, sample: DataFrame, key: str = "pid", seq: str = "seq") -> DataFrame:
    """(key, least, mean): Hamming distances of every row to a query set of at most ``QUERY_ROWS`` rows.

    The set goes to the tasks with the function, so a larger one is refused; no
    row is shuffled or copied. The least distance leaves the row itself out, the
    mean does not. Null sequences are at no distance from anything; a row
    without a distance has nulls.
    """
    return df.select(key, _to_sample(sample, key, seq)(F.col(key), F.col(seq)).alias("_d")).select(key, "_d.least", "_d.mean")


def _to_sample(sample: DataFrame, key: str, seq: str):
    """A function of (key, seq): least and mean distance to the rows of ``sample``."""
    rows = sample.select(key, seq).limit(QUERY_ROWS + 1).toArrow()
    if rows.num_rows > QUERY_ROWS:
        raise ValueError(f"a query set has at most {QUERY_ROWS} rows")
    rows = rows.filter(pc.is_valid(rows.column(seq)))
    names = pc.unique(rows.column(key))
    owner = pc.index_in(rows.column(key), value_set=names).to_numpy()
    body, offsets = S._joined(rows.column(seq).combine_chunks())
    size = np.diff(offsets)
    letters = np.unique(body)
    planes = [S.padded(body, offsets, size.max()) == x for x in letters]

    @F.arrow_udf("least long, mean double")
    def told(keys: pa.Array, column: pa.Array) -> pa.Array:
        text, at = S._joined(column)
        own = pc.index_in(keys, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        dead = column.is_null().to_numpy(zero_copy_only=False) | (len(size) == 0)
        least, mean = np.zeros(len(column), np.int64), np.zeros(len(column))
        alone = dead.copy()
        for low in range(0, len(column) if len(size) else 0, BLOCK_ROWS):
            s = slice(low, min(low + BLOCK_ROWS, len(column)))
            long = np.diff(at[s.start : s.stop + 1])
            here = S.padded(text[at[s.start] : at[s.stop]], at[s.start : s.stop + 1] - at[s.start], size.max())
            # Counts below 2^24 are exact in single precision.
            same = sum((here == x).astype(np.float32) @ p.T.astype(np.float32) for x, p in zip(letters, planes, strict=True))
            gap = np.maximum(long[:, None], size[None]) - np.asarray(same, np.int64)
            mean[s] = gap.mean(1)
            other = owner[None] != own[s, None]
            least[s] = np.where(other, gap, np.iinfo(np.int64).max).min(1)
            alone[s] |= ~other.any(1)
        return pa.StructArray.from_arrays([pa.array(least, mask=alone), pa.array(mean, mask=dead)], ["least", "mean"])

    return told


def near_duplicates(df: DataFrame, threshold: int, n: int, length: int, seed: int, key: str = "pid", seq: str = "seq") -> DataFrame:
    """Adds ``near``: whether a row is nearer than ``threshold`` to another one of a sample.

    The sample shrinks as rows grow: min(max(10, 1e8 / (n length)), n) rows, so at most 10,000.
    """
    size = min(max(10, 100_000_000 // max(1, n * length)), n)
    told = _to_sample(sample_without_replacement(df, size, key, seed), key, seq)(F.col(key), F.col(seq))
    return df.withColumn("near", F.coalesce(told["least"], F.lit(threshold)) < threshold)


# ------------------------------------------------------------------- order


#: Rows of a sorted limit, which one task reads in the end.
ONE_TASK = 10_000


def _first_k(df: DataFrame, k: int, by: str, ties: tuple[str, ...], down: bool) -> DataFrame:
    """The first k rows: a sorted limit, or for many rows those up to the k-th in order, which is found over ranges of the order's columns alone."""
    kind = dict(df.dtypes)[by]
    if k <= ONE_TASK or not ties or not (kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")):
        return df.orderBy(F.desc(by) if down else F.asc(by), *ties).limit(k)
    # As ORDER BY does: nulls are less than all numbers, NaN is more.
    none, high = F.col(by).isNull(), F.coalesce(F.isnan(by), F.lit(False)) if kind in ("float", "double") else F.lit(False)
    place = F.struct((none if down else ~none).alias("none"), (~high if down else high).alias("high"), (-F.col(by) if down else F.col(by)).alias("by"), *ties)
    last = numbered(df.select(place.alias("_last")), "_last", "_n").where(F.col("_n") < k).agg(F.max("_last").alias("_last"))
    return df.join(F.broadcast(cut(last)), place <= F.col("_last")).drop("_last")


def top_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows of the largest values. Each task keeps k rows at most; the last of ``ties`` is unique where k is large."""
    return _first_k(df, k, by, ties, True)


def bottom_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    return _first_k(df, k, by, ties, False)


def top_k_per_group(df: DataFrame, k: int, group: str, by: str, *ties: str) -> DataFrame:
    """The rank limit reaches below the shuffle (window group limit)."""
    order = Window.partitionBy(group).orderBy(F.desc(by), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_or_fill(df: DataFrame, n: int, by: str, key: str, seed: int) -> DataFrame:
    """The best n rows; a pool smaller than n is filled by draws with replacement."""
    pool = df.count()
    if pool == 0 or pool >= n:
        return top_k(df, n, by, key)
    return df.unionByName(sample_with_replacement(df, n - pool, key, seed).drop("draw"))


def elite(df: DataFrame, share: float, n: int, by: str, key: str) -> DataFrame:
    """Adds ``elite``: whether the row is among the int(share n) best."""
    best = top_k(df.select(key, by), int(share * n), by, key).select(F.col(key).alias("_elite"))
    return df.join(best, F.col(key) == F.col("_elite"), "left").withColumn("elite", F.col("_elite").isNotNull()).drop("_elite")


# ---------------------------------------------------------------- sampling


def sample_without_replacement(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly n rows (or all), by hash order."""
    return df.orderBy(rng.order_key(seed, key), key).limit(n)


def range_parts(df: DataFrame, order: Column | str, part: str = "_part", local: str = "_at") -> DataFrame:
    """``df`` dealt over ranges of ``order`` and written once, with each row's range and its number in there.

    Both come from the id that a row had when it was written, so every later job
    sees the same ranges, however adaptive execution deals its own tasks.
    """
    many = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The named sort key keeps an expression from being computed for the shuffle and the sort alike.
    rows = df.withColumn("_by", order if isinstance(order, Column) else F.col(order))
    rows = rows.repartitionByRange(many, "_by").sortWithinPartitions("_by").withColumn("_id", F.monotonically_increasing_id()).drop("_by")
    # Of a 64-bit id, the upper 31 bits tell the task and the lower 33 the row.
    return cut(rows).withColumns({part: F.shiftright("_id", 33).cast("int"), local: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def part_offsets(rows: DataFrame, figures: list[tuple[int, float | int]]) -> DataFrame:
    """A broadcast side (_part, _before) from each part's figure, parts in order: the sum of all parts before."""
    told, at = [], 0
    for part, v in figures:
        told.append((part, at))
        at += v or 0
    kind = "double" if any(isinstance(v, float) for _, v in figures) else "long"
    cast = float if kind == "double" else int
    return F.broadcast(rows.sparkSession.createDataFrame([(p, cast(v)) for p, v in told], f"_part int, _before {kind}"))


def numbered(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Row numbers from 0 in the order of ``key``: one range shuffle; only the sizes of ranges come to the driver."""
    rows = range_parts(df, key)
    sizes = [(r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()]
    return rows.join(part_offsets(rows, sizes), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n draws; ``draw`` numbers them."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(rng.uniform(seed, "draw", "id") * total).alias("idx"))
    return draws.join(numbered(df, key), "idx").drop("idx")


def weighted_without_replacement(df: DataFrame, n: int, weight: str, key: str, seed: int) -> DataFrame:
    """Efraimidis-Spirakis: the n largest ln(u) / w; rows of weight 0 never come."""
    u = F.greatest(rng.uniform(seed, "es", key), F.lit(2.0**-33))
    return df.where(F.col(weight) > 0).withColumn("_k", F.log(u) / F.col(weight)).orderBy(F.desc("_k"), key).limit(n).drop("_k")


def split_half(df: DataFrame, key: str, seed: int = 42, share: float = 0.5) -> DataFrame:
    """Adds ``half``: A for the first int(share n) rows by hash order, else B. Exact sizes, no join.

    Rows are counted by the first four digits of their hash, which tells all rows
    apart but those of the digits where the cut falls; only these are numbered.
    """
    rows = cut(df.withColumn("_h", F.struct(rng.order_key(seed, key).alias("h"), F.col(key).alias("k"))))
    digits = F.substring("_h.h", 1, 4)
    sizes = sorted((r["d"], r["n"]) for r in rows.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    left, at = int(share * sum(n for _, n in sizes)), ""
    for at, n in sizes:
        if n >= left:
            break
        left -= n
    told = rows.where(digits != at).withColumn("half", F.when(digits < at, "A").otherwise("B"))
    near = numbered(rows.where(digits == at), "_h", "_idx").withColumn("half", F.when(F.col("_idx") < left, "A").otherwise("B"))
    return told.drop("_h").unionByName(near.drop("_h", "_idx"))


# --------------------------------------------------------------- set operations


def distinct_first(df: DataFrame, on: str, *order: str) -> DataFrame:
    """The first row of each value by ``order``."""
    rest = [c for c in df.columns if c != on]
    return df.groupBy(on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(on, *(F.col(f"_r.{c}").alias(c) for c in rest))


def distinct_best(df: DataFrame, on: str, score: str, *ties: str) -> DataFrame:
    """The row of the largest score of each value; then the smallest ``ties``."""
    rest = [c for c in df.columns if c != on]
    order = F.struct((-F.col(score)).alias("s"), *ties)
    return df.groupBy(on).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(on, *(F.col(f"_r.{c}").alias(c) for c in rest))


def set_difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b.select(on), on, "left_anti")
