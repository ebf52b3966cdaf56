"""Ranks, prefix sums, Pareto fronts and crowding.

Windows over a whole table run in one task, so those here either partition or
go over two levels: partial figures of range partitions, then a window in each.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.lineage import cut
from helixframe.operators.relational import numbered, part_offsets, range_parts


def with_average_rank(df: DataFrame, value: str, name: str, group: str | None = None) -> DataFrame:
    """Average ranks from 1 over a whole table, or in each group: distinct values are counted first, then summed over ranges."""
    by = [group] if group else []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    below = prefix_sum(counts, value, "_c", "_upto", group)
    ranks = below.select(*(F.col(g).alias("_g") for g in by), F.col(value).alias("_v"), (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(name))
    same = df[value].eqNullSafe(F.col("_v"))
    if group:
        same = same & df[group].eqNullSafe(F.col("_g"))
    return df.join(ranks, same).drop("_v", "_g")


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], group: str | None = None) -> DataFrame:
    """A column for each wanted quantile (linear between neighbours), one row or one a group; nulls aside.

    Distinct values are counted and summed over ranges, so no task holds a whole column.
    """
    by = [group] if group else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    below = prefix_sum(counts, value, "_c", "_upto", group)
    size = below.groupBy(*by).agg(F.sum("_c").alias("_n"))
    rows = below.join(size, by) if group else below.join(F.broadcast(size), how="cross")
    at = lambda p: F.max(F.when((F.col("_upto") > p) & (F.col("_upto") - F.col("_c") <= p), F.col(value)))
    told = rows.groupBy(*by).agg(*(at(r(q * (F.col("_n") - 1))).alias(f"_{x}{k}") for k, q in wanted.items() for x, r in (("a", F.floor), ("b", F.ceil))), F.max("_n").alias("_n"))
    part = lambda q: q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1))
    return told.select(*by, *((F.col(f"_a{k}") + part(q) * (F.col(f"_b{k}") - F.col(f"_a{k}"))).alias(k) for k, q in wanted.items()))


def prefix_sum(df: DataFrame, order: str, value: str, name: str, group: str | None = None) -> DataFrame:
    """Running sums in the order of the unique column ``order``, in each ``group`` if one is named.

    Ranges of the table are written once and summed on their own; the sums, one
    for each range and group that meet, go back as offsets. A group that spans
    many ranges never runs in one task.
    """
    key = F.struct(group, order) if group else F.col(order)
    rows = range_parts(df, key)
    by = [group] if group else []
    sums = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    local = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(local))
    if group:
        # A row a range and group: the windows are over few rows.
        past = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        side = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_before"))
        joined = rows.join(side, rows[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).drop("_g", "_p")
    else:
        joined = rows.join(part_offsets(rows, [(r["_part"], r["_s"]) for r in sums.orderBy("_part").collect()]), "_part")
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_at", "_before")


def rank_sum(df: DataFrame, values: list[str], name: str = "rank_sum") -> DataFrame:
    out = df
    for i, v in enumerate(values):
        out = with_average_rank(out, v, f"_r{i}")
    return out.withColumn(name, F.expr(" + ".join(f"_r{i}" for i in range(len(values))))).drop(*(f"_r{i}" for i in range(len(values))))


def patience(df: DataFrame, step: str, value: str, window: int, least: float = 0.0) -> DataFrame:
    """Per step: running best, improvement over ``window`` steps, and steps since the last strict best.

    One row a step, so a single task is enough.
    """
    order = Window.orderBy(step)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns({"best": best, "gain": F.col(value) - F.lag(value, window).over(order), "_new": F.coalesce(F.col(value) > F.max(value).over(past) + least, F.lit(True))})
    out = out.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order))
    return out.withColumn("plateau", F.row_number().over(Window.partitionBy("_run").orderBy(step)) - 1).drop("_new", "_run")


def pareto_first(df: DataFrame, score: str, edits: str) -> DataFrame:
    """The rows that no other beats: largest score, smallest edits; equal rows both stay.

    Aggregated by score first; the running minimum over better scores is taken
    over two levels, so the table is never in one task.
    """
    low = df.groupBy(score).agg(F.min(edits).alias("_low"))
    rows = range_parts(low, -F.col(score))
    offsets, at = [], None
    for r in rows.groupBy("_part").agg(F.min("_low").alias("_m")).orderBy("_part").collect():
        offsets.append((r["_part"], float(at) if at is not None else None))
        at = r["_m"] if at is None else min(at, r["_m"])
    side = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before double"))
    order = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    best = rows.join(side, "_part").withColumn("_better", F.least(F.min("_low").over(order), F.col("_before")))
    front = best.where("_better is null or _low < _better").select(F.col(score).alias("_fs"), "_low")
    return df.join(front, (df[score] == F.col("_fs")) & (df[edits] == F.col("_low"))).drop("_fs", "_low")


#: Distinct (score, edits) pairs to a row of blocks of ``pareto_fronts``, on average.
PAIRS = 500_000


class Staircase:
    """The least edits of each front within a range of edits, as pairs come in order of the score.

    ``below`` fronts have their least edits below the range. When one more has,
    the first front of the range leaves it, or if it holds none, the fronts of
    the ranges above have one more below them as well.
    """

    def __init__(self, below: int, ends: list[float]):
        self.below, self.ends, self.head = below, ends, 0

    def lowered(self) -> bool:
        """One more front below the range; whether the ranges above learn of it."""
        self.below += 1
        if self.head < len(self.ends):
            self.head += 1
            return False
        return True

    def placed(self, e: float) -> tuple[int, bool]:
        """The front of a pair with ``e`` edits, and whether the ranges above have one more front below them."""
        at = bisect.bisect_right(self.ends, e, self.head)
        grown = at == len(self.ends)
        if grown:
            self.ends.append(e)
        else:
            self.ends[at] = e
        return self.below + at - self.head, grown

    def left(self) -> list[float]:
        return self.ends[self.head :]


def _block(at: np.ndarray, edits: np.ndarray, events: np.ndarray, stairs: Staircase) -> tuple[np.ndarray, np.ndarray]:
    """(front of each pair of a block, events for the block of the next range of edits); pairs and events in the order of ``at``."""
    fronts, out, k = np.zeros(len(at), np.int64), [], 0
    events, edits = events.tolist(), edits.tolist()
    for i, now in enumerate(at.tolist()):
        while k < len(events) and events[k] < now:
            if stairs.lowered():
                out.append(events[k])
            k += 1
        fronts[i], grown = stairs.placed(edits[i])
        if grown:
            out.append(now)
    out += [e for e in events[k:] if stairs.lowered()]
    return fronts, np.array(out, np.int64)


def pareto_fronts(df: DataFrame, key: str, score: str, edits: str, pairs_a_row: int = PAIRS) -> DataFrame:
    """Adds ``front`` from 0; ``key`` tells rows apart. Rows whose score or edits are null are left out.

    A row's front is the longest chain of rows that beat it, which is a patience
    sort of the distinct (score, edits) pairs. These are dealt over a grid:
    equal ranges of the order by score, and ranges of edits. A block needs the
    least edits of its fronts from the range of better scores, and from the
    range of fewer edits when fronts leave for it, so the blocks of a diagonal
    run side by side, each with the pairs of one range of scores at most.
    """
    spark = df.sparkSession
    rows = df.withColumns({"_s": F.col(score).cast("double"), "_e": F.col(edits).cast("double")}).where("_s is not null and _e is not null")
    pairs = cut(rows.select("_s", "_e").distinct())
    many = 1 + pairs.count() // pairs_a_row
    cuts = sorted(set(pairs.approxQuantile("_e", [(i + 1) / many for i in range(many - 1)], 0.2 / many))) if many > 1 else []
    at = numbered(pairs.withColumn("_o", F.struct((-F.col("_s")).alias("s"), "_e")), "_o", "at").drop("_o")
    column = sum((F.when(F.col("_e") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    grid = cut(at.select("_s", "_e", "at", F.floor(F.col("at") / pairs_a_row).cast("int").alias("i"), column.alias("j")))
    told, wide = [], len(cuts) + 1
    messages = spark.createDataFrame([], "i int, j int, below long, ends array<double>, events array<long>")

    def run(mine: pa.Table, news: pa.Table) -> pa.Table:
        i, j = ((mine if mine.num_rows else news).column(c)[0].as_py() for c in "ij")
        mine = mine.sort_by("at")
        told = {c: next((x for x in news.column(c).to_pylist() if x is not None), none) for c, none in (("below", 0), ("ends", []), ("events", []))}
        stairs = Staircase(told["below"], told["ends"])
        fronts, passed = _block(mine.column("at").to_numpy(), mine.column("_e").to_numpy(), np.array(told["events"], np.int64), stairs)
        s, e = mine.column("_s").to_pylist(), mine.column("_e").to_pylist()
        rows = [(i, j, a, b, f, None, None, None) for a, b, f in zip(s, e, fronts.tolist(), strict=True)]
        rows += [(i + 1, j, None, None, None, stairs.below, stairs.left(), None), (i, j + 1, None, None, None, None, None, passed.tolist())]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wire, strict=True)], schema=wire)

    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
    wire = pa.schema(list(zip(("i", "j", "_s", "_e", "front", "below", "ends", "events"), kinds, strict=True)))
    schema = "i int, j int, _s double, _e double, front long, below long, ends array<double>, events array<long>"
    for diagonal in range(many + wide - 1):
        here = grid.where(F.col("i") + F.col("j") == diagonal).groupBy("i", "j")
        out = cut(here.cogroup(messages.where(F.col("i") + F.col("j") == diagonal).groupBy("i", "j")).applyInArrow(run, schema))
        told.append(out.where("front is not null").select("_s", "_e", "front"))
        messages = out.where((F.col("front").isNull()) & (F.col("i") < many) & (F.col("j") < wide)).select("i", "j", "below", "ends", "events")
    fronts = reduce(DataFrame.unionByName, told) if told else pairs.select("_s", "_e", F.lit(0).cast("long").alias("front"))
    return rows.join(fronts, ["_s", "_e"]).select(*df.columns, "front")


def with_neighbours(df: DataFrame, group: str, order: str, key: str, before: str, after: str) -> DataFrame:
    """Adds the value of ``order`` of the rows before and after, by (order, key) within each group; null at its ends.

    Over ranges of the table: a group may span many, and only the first and last
    row of each range go to the neighbouring ones.
    """
    rows = range_parts(df, F.struct(group, order, key))
    local = Window.partitionBy("_part").orderBy("_at")
    beside = lambda f: (f(group).over(local), f(order).over(local))
    (bg, bv), (ag, av) = beside(F.lag), beside(F.lead)
    rows = rows.withColumns({"_bg": bg, "_bv": bv, "_ag": ag, "_av": av, "_first": F.lag("_at").over(local).isNull(), "_last": F.lead("_at").over(local).isNull()})
    edges = rows.where("_first or _last").select("_part", F.col("_first").alias("f"), F.col("_last").alias("l"), F.col(group).alias("g"), F.col(order).alias("v")).collect()
    # Two rows a range: each range looks at the nearest one that has rows.
    firsts, lasts = sorted((r for r in edges if r["f"]), key=lambda r: r["_part"]), sorted((r for r in edges if r["l"]), key=lambda r: r["_part"])
    kinds = {c: t for c, t in df.dtypes}
    side = df.sparkSession.createDataFrame(
        [(a["_part"], *((p["g"], p["v"]) if p else (None, None)), *((n["g"], n["v"]) if n else (None, None))) for a, p, n in zip(firsts, [None, *lasts], [*firsts[1:], None])],
        f"_part int, _pg {kinds[group]}, _pv {kinds[order]}, _ng {kinds[group]}, _nv {kinds[order]}",
    )
    rows = rows.join(F.broadcast(side), "_part")
    of = lambda edge, g, v, og, ov: F.when(F.col(edge), F.when(F.col(og).eqNullSafe(F.col(group)), F.col(ov))).otherwise(F.when(F.col(g).eqNullSafe(F.col(group)), F.col(v)))
    return rows.withColumns({before: of("_first", "_bg", "_bv", "_pg", "_pv"), after: of("_last", "_ag", "_av", "_ng", "_nv")}).select(*df.columns, before, after)


def crowding(df: DataFrame, score: str, edits: str, key: str) -> DataFrame:
    """Adds ``crowding`` within each front: ends, and fronts of at most two, are infinite. A front may span many tasks."""
    spans = df.groupBy("front").agg(F.count(F.lit(1)).alias("_n"), *((F.max(c) - F.min(c)).alias(f"_w{i}") for i, c in enumerate((score, edits))))
    out = df
    for i, c in enumerate((score, edits)):
        out = with_neighbours(out, "front", c, key, f"_b{i}", f"_a{i}")
    out = out.join(spans.withColumnRenamed("front", "_f"), F.col("front") == F.col("_f"))
    part = lambda i: F.when(F.col(f"_b{i}").isNull() | F.col(f"_a{i}").isNull(), F.lit(float("inf"))).when(F.col(f"_w{i}") > 0, (F.col(f"_a{i}") - F.col(f"_b{i}")) / F.col(f"_w{i}")).otherwise(0.0)
    return out.withColumn("crowding", F.when(F.col("_n") <= 2, F.lit(float("inf"))).otherwise(part(0) + part(1))).select(*df.columns, "crowding")


def pareto_fitness(df: DataFrame) -> DataFrame:
    """Adds ``pareto_fitness`` = (fronts - front) + 0.5 crowding / largest finite crowding; infinite counts 1."""
    finite = F.col("crowding") < float("inf")
    top = df.agg((F.max("front") + 1).alias("_f"), F.coalesce(F.max(F.when(finite, F.col("crowding"))), F.lit(1.0)).alias("_m"))
    part = F.when(finite, F.col("crowding") / (F.col("_m") + 1e-8)).otherwise(1.0)
    return df.join(F.broadcast(top), how="cross").withColumn("pareto_fitness", F.col("_f") - F.col("front") + 0.5 * part).drop("_f", "_m")
