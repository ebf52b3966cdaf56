"""Bounded archives of checkpoints: rows (step, pid, seq, score, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.functions.lineage import new_path
from helixframe.operators import ranking, relational

#: Rows that one task folds as they are, and candidates in a block of checkpoints.
FOLDED, BLOCK = 1 << 20, 1 << 13
#: Bounds that cut a signal's values, in a checkpoint and in all of them.
BOUNDS, ALL_BOUNDS = 256, 1 << 17


def threshold(df: DataFrame, score: str, least: float) -> DataFrame:
    """Every row strictly above; duplicates stay."""
    return df.where(F.col(score) > least)


def top_distinct(df: DataFrame, k: int, seq: str = "seq", score: str = "score", step: str = "step") -> DataFrame:
    """The k best distinct sequences with their largest score and the first step that reached it."""
    best = df.groupBy(seq).agg(F.max(score).alias(score), F.min_by(step, F.struct((-F.col(score)).alias("s"), step)).alias(step))
    return relational.top_k(best, k, score, seq)


def top_margin(df: DataFrame, k: int, margin: str = "margin", *ties: str) -> DataFrame:
    return relational.top_k(df, k, margin, *ties)


def per_step(df: DataFrame, k: int, score: str = "score", *ties: str) -> DataFrame:
    return relational.top_k_per_group(df, k, "step", score, *ties)


def best_step(df: DataFrame, score: str = "score", step: str = "step") -> DataFrame:
    """One row: the step of the largest mean, the earliest on ties."""
    means = df.groupBy(step).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.agg(F.min_by(F.struct(step, "mean", "n"), F.struct((-F.col("mean")).alias("m"), step)).alias("b")).select(f"b.{step}", "b.mean", "b.n")


def best_snapshot(df: DataFrame, score: str = "score", step: str = "step") -> DataFrame:
    return df.join(F.broadcast(best_step(df, score, step).select(step)), step, "left_semi")


def budget_merge(archive: DataFrame | None, new: DataFrame, capacity: int, signals: list[str], key: str = "row_id") -> DataFrame:
    """archive and one new checkpoint together, cut to the largest rank sums if they exceed the capacity; for streams."""
    merged = new if archive is None else archive.unionByName(new)
    if capacity <= 0:
        return merged.limit(0)
    if merged.count() <= capacity:
        return merged
    ranked = ranking.rank_sum(merged, signals, "_rank")
    return ranked.orderBy(F.desc("_rank"), key).limit(capacity).drop("_rank")


def _average_ranks(values: np.ndarray) -> np.ndarray:
    _, which, n = np.unique(values, return_inverse=True, return_counts=True)
    upto = np.cumsum(n)
    return (upto - (n - 1) / 2)[which]


def _best_by_rank_sum(rows: pa.Table, capacity: int, signals: list[str], key: str) -> pa.Table:
    """The ``capacity`` rows of the largest sum of average ranks, the smallest key on ties; nulls rank lowest."""
    if rows.num_rows <= capacity:
        return rows
    ranks = sum(_average_ranks(rows.column(c).cast(pa.float64()).fill_null(-np.inf).to_numpy()) for c in signals)
    order = np.lexsort((rows.column(key).to_numpy(), -ranks))
    return rows.take(pa.array(np.sort(order[:capacity])))


def budget(df: DataFrame, capacity: int, signals: list[str], step: str = "step", key: str = "row_id", group: str | None = None, folded: int = FOLDED, block: int = BLOCK) -> DataFrame:
    """The budget archive over all checkpoints in the order of ``step``, or one for each ``group``.

    After each checkpoint the archive and its rows together are cut to the
    ``capacity`` largest rank sums; ranks are among those rows, so checkpoints
    depend on the ones before. Up to ``folded`` rows pass through one task in
    order. Of more, a task sees only the candidates of at most ``block``, and how
    many other rows lie between their values. With ``group``, groups run side by
    side, and a task holds one of a group's populations.
    """
    if group:
        return _in_order(df, capacity, signals, step, key, group)
    if capacity <= 0:
        return df.limit(0)
    sizes = df.groupBy(F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()
    if sum(r["n"] for r in sizes) <= folded:
        return _in_order(df, capacity, signals, step, key)
    return _by_candidates(df, capacity, signals, step, key, sizes, folded, block)


def _in_order(df: DataFrame, capacity: int, signals: list[str], step: str, key: str, group: str | None = None) -> DataFrame:
    """The rows of a group pass once, in order; what is carried from one checkpoint to the next is at most ``capacity`` rows."""
    schema = df.schema
    wire = to_arrow_schema(schema)

    def run(batches):
        held: list[pa.Table] = []
        archive, at = wire.empty_table(), None

        def folded() -> pa.Table:
            return _best_by_rank_sum(pa.concat_tables([archive, *held]), capacity, signals, key) if capacity > 0 else wire.empty_table()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).cast(wire)
            names = [*([group] if group else []), step]
            marks = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
            begin = 0
            for i in range(1, len(marks) + 1):
                if i < len(marks) and marks[i] == marks[begin]:
                    continue
                if at is not None and marks[begin] != at:
                    archive, held = folded(), []
                    if group and marks[begin][0] != at[0]:
                        yield from archive.to_batches()
                        archive = wire.empty_table()
                at = marks[begin]
                held.append(table.slice(begin, i - begin))
                begin = i
        if held:
            yield from folded().to_batches()

    order = [*([group] if group else []), step, key]
    dealt = df.repartition(group) if group else df.repartition(1)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)


def _codes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 i for a value below bound i and above the one before, 2 i + 1 for one that equals it; NaN is largest."""
    at = np.searchsorted(bounds, values)
    near = np.append(bounds, np.nan)[at]
    return 2 * at + ((near == values) | (np.isnan(near) & np.isnan(values) & (at < len(bounds))))


def _by_step(batch: pa.RecordBatch):
    """(step, its rows) for each step of a batch."""
    steps = batch.column("_t").to_numpy()
    order = np.argsort(steps, kind="stable")
    cuts = np.flatnonzero(np.diff(steps[order])) + 1
    return [(int(steps[rows[0]]), rows) for rows in np.split(order, cuts) if len(rows)]


def _counted(rows: DataFrame, bounds, names: list[str]) -> DataFrame:
    """_t, signal, code, n: how many of a checkpoint's values have each code by ``bounds(step, signal)``."""

    def run(batches):
        for batch in batches:
            values = [batch.column(c).to_numpy() for c in names]
            for t, mine in _by_step(batch):
                for i, v in enumerate(values):
                    code, n = np.unique(_codes(v[mine], bounds(t, i)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t)), pa.array(np.full(len(code), i, np.int32)), pa.array(code), pa.array(n)], ["_t", "signal", "code", "n"])

    told = rows.select("_t", *names).mapInArrow(run, "_t long, signal int, code long, n long")
    return told.groupBy("_t", "signal", "code").agg(F.sum("n").alias("n"))


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_reach(rows: DataFrame, names: list[str], steps: int) -> DataFrame:
    """Adds ``_low`` and ``_high``, between which a row's rank sum within its checkpoint lies.

    Approximate quantiles cut each checkpoint's values, and the counts between
    them are exact; a value that equals a cut has its exact rank.
    """
    many = min(BOUNDS, ALL_BOUNDS // (steps * len(names)))
    cuts = {}
    if many:
        shares = F.array(*(F.lit((k + 1) / (many + 1)) for k in range(many)))
        for r in rows.groupBy("_t").agg(*(F.percentile_approx(c, shares, 4 * BOUNDS).alias(c) for c in names)).collect():
            for i, c in enumerate(names):
                v = np.unique(np.array(r[c], np.float64))
                cuts[r["_t"], i] = v[~np.isnan(v)]
    none = np.zeros(0)
    bounds = lambda t, i: cuts.get((t, i), none)
    told = _counted(rows, bounds, names).toArrow().sort_by([("_t", "ascending"), ("signal", "ascending")])
    t, signal, code, n = (told.column(c).to_numpy() for c in ("_t", "signal", "code", "n"))
    begins = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(signal) != 0)])
    ranks = {}
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(t)], strict=True):
        size = np.zeros(2 * len(bounds(int(t[a]), int(signal[a]))) + 1)
        size[code[a:b]] = n[a:b]
        upto, exact = np.cumsum(size), np.arange(len(size)) % 2 == 1
        middle = upto - (size - 1) / 2
        ranks[int(t[a]), int(signal[a])] = np.where(exact, middle, upto - size + 1), np.where(exact, middle, upto)

    def run(batches):
        for batch in batches:
            low, high = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            values = [batch.column(c).to_numpy() for c in names]
            for t, mine in _by_step(batch):
                for i, v in enumerate(values):
                    at, (least, most) = _codes(v[mine], bounds(t, i)), ranks[t, i]
                    low[mine] += least[at]
                    high[mine] += most[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], [*batch.schema.names, "_low", "_high"])

    return rows.mapInArrow(run, rows.withColumns({"_low": F.lit(0.0), "_high": F.lit(0.0)}).schema)


def _largest(rows: DataFrame, k: int) -> DataFrame:
    """_t and the k largest ``_low`` of each checkpoint in each task, without a sort of its rows."""

    def run(batches):
        best = {}
        for batch in batches:
            low = batch.column("_low").to_numpy()
            for t, mine in _by_step(batch):
                some = np.r_[best[t], low[mine]] if t in best else low[mine]
                best[t] = np.partition(some, len(some) - k)[-k:] if len(some) > k else some
        for t, some in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t)), pa.array(some)], ["_t", "_low"])

    return rows.select("_t", "_low").mapInArrow(run, "_t long, _low double")


def _by_candidates(df: DataFrame, capacity: int, signals: list[str], step: str, key: str, sizes: list, folded: int, block: int) -> DataFrame:
    """The budget archive where no task holds a checkpoint's population.

    The archive adds at most ``capacity`` to a row's rank by a signal, so a row
    whose rank sum among its checkpoint is further than that, for each signal, below the
    ``capacity``-th largest there is never kept; of equal rows only the
    ``capacity`` smallest keys are. What is left are candidates. Their ranks
    come from counts of all rows between the values of a block's candidates.
    Checkpoints of few rows go in blocks of ``folded`` rows; one of many candidates
    is ranked over ranges of the table.
    """
    spark, names = df.sparkSession, [f"_s{i}" for i in range(len(signals))]
    kind = df.schema[step].dataType.simpleString()
    numbers = spark.createDataFrame([(r["step"], t) for t, r in enumerate(sizes)], f"_step {kind}, _t long")
    rows = df.join(F.broadcast(numbers), df[step].eqNullSafe(F.col("_step"))).drop("_step")
    rows = rows.withColumns({c: F.coalesce(F.col(s).cast("double"), F.lit(float("-inf"))) for c, s in zip(names, signals, strict=True)})
    whole = _kept(rows.withColumn("_id", F.monotonically_increasing_id()), "budget-rows")
    narrow = whole.select("_t", F.col(key).alias("_key"), *names, "_id")
    reach = _kept(_with_reach(narrow, names, len(sizes)), "budget-reach")
    lines = relational.top_k_per_group(_largest(reach, capacity), capacity, "_t", "_low").groupBy("_t")
    lines = lines.agg(F.when(F.count(F.lit(1)) == capacity, F.min("_low") - len(names) * capacity).otherwise(0.0).alias("_line"))
    same = Window.partitionBy("_t", *names).orderBy("_key", "_id")
    told = reach.join(F.broadcast(lines), "_t").where("_high >= _line").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= capacity)
    candidates = _kept(told.select(*narrow.columns), "budget-candidates")
    n = [r["n"] for r in sizes]
    some = {r["_t"]: r["n"] for r in candidates.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect()}
    archive, t = spark.createDataFrame([], narrow.schema).toArrow(), 0
    while t < len(n):
        ends = []
        for each, most in ((n, folded), (some, block)):
            end, left = t, most
            while end < len(n) and each[end] <= left:
                left -= each[end]
                end += 1
            ends.append(end)
        end = max(*ends, t + 1)
        here = F.col("_t").between(t, end - 1)
        before = spark.createDataFrame(archive, narrow.schema).withColumn("_t", F.lit(-1).cast("long"))
        if ends[0] == end:
            told = _in_order(narrow.where(here).unionByName(before), capacity, names, "_t", "_key")
            archive = told.toArrow()
        elif ends[1] == end:
            order = [("_t", "ascending"), ("_key", "ascending"), ("_id", "ascending")]
            members = before.unionByName(candidates.where(here)).toArrow().sort_by(order)
            archive = members.take(_block_of_candidates(narrow.where(here), members, capacity, names))
        else:
            archive = budget_merge(before, narrow.where(here), capacity, names, "_key").toArrow()
        t = end
    ids = spark.createDataFrame(archive, narrow.schema).select("_id")
    return whole.join(F.broadcast(ids), "_id", "left_semi").select(*df.columns)


def _block_of_candidates(rows: DataFrame, members: pa.Table, capacity: int, names: list[str]) -> pa.Array:
    """Which of ``members`` are kept after the checkpoints of ``rows``: the archive before (step -1) and the candidates, in order."""
    steps, keys = members.column("_t").to_numpy(), members.column("_key").to_numpy()
    values = [np.unique(members.column(c).to_numpy()) for c in names]
    places = [np.searchsorted(v, members.column(c).to_numpy()) for v, c in zip(values, names, strict=True)]

    def fold(batches):
        sizes = [np.zeros(2 * len(v) + 1, np.int64) for v in values]
        archive, now = np.arange(np.searchsorted(steps, 0)), None

        def merged() -> np.ndarray:
            both = np.r_[archive, np.arange(*np.searchsorted(steps, [now, now + 1]))]
            if sizes[0].sum() + len(archive) <= capacity:
                return both
            total = np.zeros(len(both))
            for place, size in zip(places, sizes, strict=True):
                at, held = place[both], np.sort(place[archive])
                low, high = np.searchsorted(held, at), np.searchsorted(held, at, "right")
                total += np.cumsum(size)[2 * at] + low + (size[2 * at + 1] + high - low + 1) / 2
            return np.sort(both[np.lexsort((keys[both], -total))[:capacity]])

        for batch in batches:
            t, signal, code, n = (batch.column(c).to_numpy() for c in ("_t", "signal", "code", "n"))
            for step, mine in _by_step(batch):
                if now is not None and step != now:
                    archive = merged()
                    for size in sizes:
                        size[:] = 0
                now = step
                for i, size in enumerate(sizes):
                    at = mine[signal[mine] == i]
                    size[code[at]] += n[at]
        if now is not None:
            archive = merged()
        yield pa.RecordBatch.from_arrays([pa.array(archive.astype(np.int64))], ["member"])

    told = _counted(rows, lambda t, i: values[i], names).repartition(1).sortWithinPartitions("_t")
    return told.mapInArrow(fold, "member long").toArrow().column("member").combine_chunks()


def history(df: DataFrame, score: str = "score", step: str = "step", window: int = 3) -> DataFrame:
    """Per step: mean, maximum, deviation, n, distinct sequences, and the patience figures."""
    per = df.groupBy(step).agg(F.avg(score).alias("mean"), F.max(score).alias("max"), F.stddev_pop(score).alias("std"), F.count(F.lit(1)).alias("n"))
    return ranking.patience(per, step, "mean", window)


def reject_share(df: DataFrame, accepted: str) -> DataFrame:
    """The share of proposals turned down, per step."""
    return df.groupBy("step").agg((1 - F.avg(F.col(accepted).cast("double"))).alias("reject_share"))


def last_window(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Rows of the last n steps."""
    last = df.agg(F.max(step).alias("_last"))
    return df.join(F.broadcast(last), F.col(step) > F.col("_last") - n).drop("_last")


def unique_per_window(df: DataFrame, seq: str = "seq", step: str = "step") -> DataFrame:
    """Rows whose sequence is seen for the first time."""
    order = Window.partitionBy(seq).orderBy(step, "pid")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
