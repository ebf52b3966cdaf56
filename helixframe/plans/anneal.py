"""Population annealing as a loop of DataFrame jobs.

A step: find the largest temperature step that keeps enough effective rows,
resample by systematic or stratified draws (or in islands), refresh the lowest
rows, swap between islands, propose branches, score them, pick one, spread near
duplicates, update history. The population is a table cut each step; what comes
to the driver is sums, and a row of each island.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import rng, schedule
from helixframe.functions.lineage import cut
from helixframe.functions.sequence import gc
from helixframe.operators import profiles, proposals, relational, resample
from helixframe.operators.relational import elite, numbered
from helixframe.plans import blocks


@dataclass
class AnnealConfig:
    max_beta: float = 5.0
    max_steps: int = 50
    hard_max_steps: int = 0
    ess_share: float = 0.5
    beta_cap: float | None = None
    noise: float = 0.10
    noise_end: float | None = None
    branches: int = 4
    branch_schedule: str | list[int] | None = None
    edit_share: float | None = None
    step_cap: int | None = None
    criterion: str = "oracle"
    tau: float = 0.0
    elite_share: float = 0.0
    max_copies: int | None = None
    temperature: float = 1.0
    gc_edges: list[float] | None = None
    gc_mode: str = "raw"
    gc_least: int = 0
    diversity: float = 0.0
    rejuvenate_share: float = 0.0
    #: Where fresh rows come from: ``uniform``, ``diverse`` (those farthest from the population) or ``pool``; and their noise.
    rejuvenate_from: str = "uniform"
    rejuvenate_noise: float = 0.0
    patience: int = 0
    noise_boost: float = 0.0
    noise_max: float = 0.5
    extend_steps: int = 0
    extend_beta: float = 0.0
    #: Islands of n // islands neighbouring rows each; their temperatures, and the steps between swaps.
    islands: int = 0
    temperatures: tuple[float, ...] = ()
    swap_every: int = 1
    #: Rows nearer than this to a sample of the others are mutated again, at ``spread_noise`` times the noise.
    spread_below: int = 0
    spread_noise: float = 2.0
    spread_rounds: int = 2
    #: Weights are divided by the chance of the branch that was picked; matters for tau > 0.
    branch_correction: bool = False
    #: Sequences that were scored before aren't scored again.
    memo: bool = False
    #: Branches that a surrogate, refitted every so many steps, leaves for the scorer.
    surrogate_keep: int = 0
    surrogate_every: int = 5
    seed: int = 0


#: Recipes by name. Population sizes belong to the seed pool.
PRESETS = {
    "toy": AnnealConfig(max_beta=10.0, max_steps=30, noise=0.05, branches=4),
    "enhancer": AnnealConfig(max_beta=25.0, max_steps=30, branches=8),
    "activity": AnnealConfig(max_beta=10.0, max_steps=30, branches=8),
    "cross_oracle": AnnealConfig(max_beta=2000.0, beta_cap=6.67, max_steps=400, noise=0.05, branches=10),
    "promoter": AnnealConfig(max_beta=100.0, max_steps=60, noise=0.05, branches=8),
}


#: A column of the scorer's by name or expression, or a list with one for each island.
Fitness = str | Column | list


@dataclass
class AnnealResult:
    population: DataFrame
    best_population: DataFrame
    best_step: int
    history: list[dict] = field(default_factory=list)


class _Scoring:
    """The scorer with the fitness on top, and the memo of known sequences if one is kept."""

    def __init__(self, scorer: proposals.Scorer, fitness: Fitness, memo: bool, island: Callable[[], Column]):
        self.scorer, self.keep = scorer, memo
        one = lambda f: F.col(f) if isinstance(f, str) else f
        if isinstance(fitness, list | tuple):
            # Rows beyond the last whole island, and fresh ones without a place, go by the first.
            own, each = island(), [one(f) for f in fitness]
            self.fit, self.by_island = F.coalesce(*(F.when(own == i, f) for i, f in enumerate(each)), each[0]), True
        else:
            self.fit, self.by_island = one(fitness), False
        self.known: DataFrame | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``seq``) and ``fitness``; what else a scorer adds doesn't travel."""
        names = df.columns
        if self.by_island and "pid" not in names:
            return self(df.withColumn("pid", F.lit(-1).cast("long"))).drop("pid")
        if not self.keep:
            return self.scorer.score(df).withColumn("fitness", self.fit).select(*names, "fitness")
        new = df.select("seq").distinct()
        if self.known is not None:
            new = new.join(self.known, "seq", "left_anti")
        new = self.scorer.score(new).withColumn("fitness", self.fit).select("seq", "fitness")
        self.known = cut(new if self.known is None else self.known.unionByName(new))
        return df.join(self.known, "seq", "left").select(*names, "fitness")


def _copies(rows: DataFrame, config: AnnealConfig, n: int, u0: float) -> DataFrame:
    """Adds ``copies``: by GC bins, by islands (rows beyond the last whole island stay once), or over all."""
    if config.gc_edges:
        return resample.stratified_copies(rows.withColumn("_gc", gc("seq")), "weight", "pid", "_gc", "selection", config.gc_edges, n, u0, config.gc_mode, least=config.gc_least).drop("_gc", "bin")
    if not config.islands:
        return resample.systematic_copies(rows, "weight", "pid", u0)
    inside = resample.systematic_copies(rows.where("island is not null"), "weight", "pid", u0, group="island")
    return inside.unionByName(rows.where("island is null").withColumn("copies", F.lit(1).cast("long")))


def _island(config: AnnealConfig, n: int):
    """The island of a pid; null beyond the last whole one."""
    size = max(1, n // max(1, config.islands))
    at = F.floor(F.col("pid") / size).cast("int")
    return F.when(at < config.islands, at)


def _selection(now: DataFrame, config: AnnealConfig, n: int) -> DataFrame:
    """Adds ``selection``: the fitness less the penalty for likeness to the consensus, of all rows or of the row's island.

    Steps and weights go by it; ``fitness`` stays what the scorer gave, so that
    a row that is kept isn't penalised again for the steps before.
    """
    if not config.diversity:
        return now.withColumn("selection", F.col("fitness"))
    if config.islands:
        rows = profiles.conformity(now.withColumn("island", _island(config, n)), group="island").drop("island")
    else:
        rows = profiles.conformity(now)
    return rows.withColumn("selection", F.col("fitness") - config.diversity * F.coalesce("conformity", F.lit(0.0))).drop("conformity")


def _fresh(kept: DataFrame, config: AnnealConfig, propose, pool: DataFrame | None, many: int, length: int, step: int) -> DataFrame:
    """(slot, seq, origin) of rows that start anew: the most diverse ones, draws from a pool, or random ones; mutated at once if ``rejuvenate_noise`` says so."""
    if config.rejuvenate_from == "diverse":
        fresh = resample.diverse_source(kept, many)
    elif config.rejuvenate_from == "pool":
        if pool is None:
            raise ValueError("rejuvenation from a pool needs one")
        fresh = resample.pool_source(pool, many, "pid", config.seed + step)
    else:
        fresh = resample.uniform_source(kept.sparkSession, many, length, config.seed + step, "rejuvenate")
    fresh = fresh.withColumn("origin", F.col("seq"))
    if not config.rejuvenate_noise:
        return fresh
    boosted = propose(config.rejuvenate_noise, config.seed * 1000 + step + 900).expand(fresh.withColumnRenamed("slot", "pid"), 1, step)
    return boosted.select(F.col("pid").alias("slot"), "seq", "origin")


def _exchanged(kept: DataFrame, config: AnnealConfig, beta: float, step: int, draws) -> DataFrame:
    """One row of each island, drawn by hash, may change places with one of the next island."""
    order = F.struct(rng.order_key(config.seed, F.lit("swap"), F.lit(step), "pid"), "pid")
    drawn = kept.where("island is not null").groupBy("island").agg(F.min_by(F.struct("pid", "fitness"), order).alias("d")).orderBy("island")
    best = [(r["d"]["pid"], r["d"]["fitness"]) for r in drawn.collect()]
    pairs = resample.swap_map(best, list(config.temperatures), beta, draws.random(len(best)).tolist())
    return resample.swapped(kept, pairs)


def _spread(now: DataFrame, config: AnnealConfig, propose, scoring: _Scoring, accept, rate: float, n: int, length: int, step: int) -> DataFrame:
    """Near duplicates are mutated again; one that fails ``accept`` keeps its sequence."""
    for r in range(config.spread_rounds):
        told = cut(relational.near_duplicates(now, config.spread_below, n, length, config.seed + 7919 * step + r))
        if told.where("near").isEmpty():
            break
        near = told.where("near").drop("near", "fitness").withColumn("parent", F.col("seq"))
        again = propose(rate * config.spread_noise, config.seed * 1000 + step + 500 + r).expand(near, 1, step).drop("k")
        if accept is not None:
            again = again.withColumn("seq", F.when(accept(F.col("seq")), F.col("seq")).otherwise(F.col("parent")))
        now = cut(told.where("not near").drop("near").unionByName(scoring(again.drop("parent")).select(*now.columns)))
    return now


def anneal(
    seeds: DataFrame,
    scorer: proposals.Scorer,
    config: AnnealConfig,
    fitness: Fitness = "score",
    proposal: Callable[[float, int], proposals.Proposal] | None = None,
    accept: Callable | None = None,
    on_step: Callable[[int, DataFrame, dict], None] | None = None,
    state: str | None = None,
    pool: DataFrame | None = None,
) -> AnnealResult:
    """seeds: (pid, seq). ``accept`` maps a sequence column to a condition; a proposal that fails it is reverted.

    ``fitness``: a column of the scorer's, or one for each island. ``pool``: (pid, seq) that rejuvenation draws from.
    A proposal that adds ``log_ratio`` (the log of how much likelier an unguided draw was) has it counted in the weights
    under ``branch_correction``.
    ``state``: a folder where each step is written; a run that finds steps there goes on after the last.
    Without a proposal positions are redrawn as by ``Sparse``. Plain runs of a scorer with ``values`` go by blocks, with the same draws.
    """
    spark = seeds.sparkSession
    if proposal is None and accept is None and state is None and fitness == "score" and hasattr(scorer, "values") and _plain(config):
        start = blocks.Blocks.of(seeds.select("pid", "seq"), scorer.values)
        if start is not None:
            return _by_blocks(start, scorer.values, config, on_step)
    propose = proposal or (lambda rate, seed: proposals.Sparse(rate, seed))
    if not isinstance(fitness, str | Column) and not callable(fitness) and (len(fitness) != config.islands or config.memo):
        raise ValueError("fitness by island needs one for each island, and no memo")
    scoring = _Scoring(scorer, fitness, config.memo, lambda: _island(config, seeds.count()))
    at = _Scalars(noise=config.noise, limit=config.max_steps)
    told: list[dict] = []
    found = read_state(spark, state) if state else None
    if found:
        now, best, at, told = found
    else:
        start = numbered(seeds.select("pid", "seq"), "pid", "_n").select(F.col("_n").alias("pid"), "seq", F.col("seq").alias("origin"))
        now = best = cut(scoring(start).withColumn("log_p", F.lit(0.0)))
    n = now.count()
    if not n:
        return AnnealResult(now, now, -1)
    length = now.select(F.max(F.length("seq"))).first()[0]
    cap = None if config.edit_share is None else int(config.edit_share * length)
    surrogate = None
    while at.step < at.limit and not at.done:
        step, draws = at.step, np.random.default_rng([config.seed, at.step])
        remaining = config.max_beta - at.beta
        if config.beta_cap is not None:
            remaining = min(remaining, config.beta_cap)
        rows = _selection(now, config, n)
        delta = resample.largest_step(rows, "selection", remaining, config.ess_share)
        if delta < 1e-4:
            break
        at.beta += delta
        at.log_z += profiles.effective_size(rows.withColumn("_lw", delta * F.col("selection")), "_lw").first()["log_mean_exp"]
        rows = rows.withColumn("_lw", delta * F.col("selection") - (F.col("log_p") if config.branch_correction else 0.0))
        real_ess = profiles.effective_size(rows, "_lw").first()["ess"]
        heat = config.temperature
        if config.islands:
            rows = rows.withColumn("island", _island(config, n))
            if config.temperatures:
                heat = F.coalesce(F.get(F.array(*map(F.lit, map(float, config.temperatures))), F.col("island")), F.lit(1.0))
        weighted = resample.tempered(rows, "_lw", heat).drop("_lw")
        copies = _copies(weighted, config, n, float(draws.random()))
        if config.max_copies:
            copies = resample.capped(copies, config.max_copies, "weight", "pid", config.seed + step)
        kept = resample.expand(copies.select("pid", "seq", "origin", "fitness", "copies"))
        kept = cut(numbered(kept.withColumn("_o", F.struct("pid", "copy")), "_o", "_new").select(F.col("_new").alias("pid"), "seq", "origin", "fitness"))
        if config.rejuvenate_share and step > 0:
            fresh = _fresh(kept, config, propose, pool, max(1, int(config.rejuvenate_share * n)), length, step)
            kept = cut(resample.rejuvenated(kept, scoring(fresh), config.rejuvenate_share, "fitness"))
        if config.islands and config.temperatures and step % config.swap_every == 0:
            kept = _exchanged(kept.withColumn("island", _island(config, n)), config, at.beta, step, draws).drop("island")
        share = schedule.progress(at.beta, 0.0, config.max_beta)
        rate = at.noise if config.noise_end is None else schedule.annealed(at.noise, config.noise_end, share)
        k = schedule.branches(config.branch_schedule, config.branches, step, at.limit)
        movers = elite(kept, config.elite_share, n, "fitness", "pid") if config.elite_share else kept.withColumn("elite", F.lit(False))
        movers = movers.withColumns({"parent": F.col("seq"), "parent_fitness": F.col("fitness")}).drop("fitness")
        grown = propose(rate, config.seed * 1000 + step).expand(movers, k, step)
        grown = grown.withColumn("seq", F.when(F.col("elite"), F.col("parent")).otherwise(F.col("seq")))
        if accept is not None:
            grown = grown.withColumn("seq", F.when(accept(F.col("seq")), F.col("seq")).otherwise(F.col("parent")))
        if config.surrogate_keep:
            if surrogate is None or step % config.surrogate_every == 0:
                surrogate = proposals.ridge_surrogate(now, "fitness")
            grown = proposals.prefiltered(grown.withColumn("_guess", proposals.surrogate_score(surrogate)), config.surrogate_keep, "_guess").drop("_guess")
        ratio = F.col("log_ratio") if "log_ratio" in grown.columns else F.lit(0.0)
        scored = scoring(grown.select("pid", "k", "seq", "parent", "origin", "parent_fitness", ratio.alias("log_ratio")))
        picked = proposals.chosen_branch(scored, "fitness", length, cap, config.step_cap, config.criterion, config.tau, config.seed, step)
        # A reverted row has its parent's fitness, which is known: nothing is scored twice.
        value = F.when(F.col("valid"), F.col("fitness")).otherwise(F.col("parent_fitness"))
        # Weights are divided by exp(log_p): what a guided draw was too likely counts there, too.
        log_p = F.col("log_p") - F.when(F.col("valid") & (F.col("seq") != F.col("parent")), F.col("log_ratio")).otherwise(0.0)
        now = cut(picked.select("pid", "seq", "origin", value.alias("fitness"), log_p.alias("log_p")))
        if config.spread_below:
            now = _spread(now, config, propose, scoring, accept, rate, n, length, step)
        one = now.agg(F.avg("fitness").alias("mean"), F.max("fitness").alias("max"), F.stddev_pop("fitness").alias("std"), F.count_distinct("seq").alias("n_unique"), F.count(F.lit(1)).alias("n")).first().asDict()
        told.append(one | {"step": step, "beta": at.beta, "delta_beta": delta, "ess": real_ess, "log_z": at.log_z, "branches": k, "noise": rate})
        if one["mean"] > at.best_mean:
            best, at.best_mean, at.best_step, at.stale = now, one["mean"], step, 0
        else:
            at.stale += 1
        if on_step:
            on_step(step, now, told[-1])
        at.settle(config, delta)
        if state:
            write_state(state, now, best if at.best_step == step else None, at, told[-1])
    return AnnealResult(now, best, at.best_step, told)


#: What a run by blocks heeds; all else must be as it is by default.
_HEEDED = {"max_beta", "max_steps", "hard_max_steps", "ess_share", "beta_cap", "noise", "noise_end", "branches", "branch_schedule", "temperature"} | {"patience", "noise_boost", "noise_max", "extend_steps", "extend_beta", "seed"}


def _plain(config: AnnealConfig) -> bool:
    usual = AnnealConfig()
    return all(getattr(config, k) == v for k, v in vars(usual).items() if k not in _HEEDED)


def _by_blocks(start: blocks.Blocks, values: Callable[[np.ndarray], np.ndarray], config: AnnealConfig, on_step: Callable[[int, DataFrame, dict], None] | None) -> AnnealResult:
    """``anneal`` for a ``_plain`` config: generations are files of blocks, and one that nothing reads any more is deleted."""
    at, told = _Scalars(noise=config.noise, limit=config.max_steps), []
    now = best = start
    top = now.best()
    while at.step < at.limit and not at.done:
        step, draws = at.step, np.random.default_rng([config.seed, at.step])
        remaining = config.max_beta - at.beta
        if config.beta_cap is not None:
            remaining = min(remaining, config.beta_cap)
        delta = now.largest_step(remaining, config.ess_share)
        if delta < 1e-4:
            break
        at.beta += delta
        weighed, whole, real_ess, gain, sums = now.weighed(delta, top, config.temperature)
        at.log_z += gain
        rate = at.noise if config.noise_end is None else schedule.annealed(at.noise, config.noise_end, schedule.progress(at.beta, 0.0, config.max_beta))
        k = schedule.branches(config.branch_schedule, config.branches, step, at.limit)
        past, now = now, now.grown(weighed, whole, sums, float(draws.random()), values, rate, config.seed * 1000 + step, k, step)
        one = now.summary()
        top = one["max"]
        told.append(one | {"step": step, "beta": at.beta, "delta_beta": delta, "ess": real_ess, "log_z": at.log_z, "branches": k, "noise": rate})
        last = best
        if one["mean"] > at.best_mean:
            best, at.best_mean, at.best_step, at.stale = now, one["mean"], step, 0
        else:
            at.stale += 1
        for path, x in {past.path: past, last.path: last}.items():
            if path not in (start.path, now.path, best.path):
                x.drop(release=step % 4 == 3)
        if on_step:
            on_step(step, now.rows(start), told[-1])
        at.settle(config, delta)
    return AnnealResult(now.rows(start), best.rows(start), at.best_step, told)


@dataclass
class _Scalars:
    """What a run carries from step to step beside the population."""

    noise: float
    limit: int
    step: int = 0
    beta: float = 0.0
    log_z: float = 0.0
    best_mean: float = -float("inf")
    best_step: int = -1
    stale: int = 0
    done: bool = False

    def settle(self, config: AnnealConfig, delta: float) -> None:
        """After a step: more noise or an end on a plateau, the end at the last temperature, or more steps."""
        if config.patience and self.stale >= config.patience:
            if not config.noise_boost or self.noise >= config.noise_max:
                self.done = True
            self.noise, self.stale = min(config.noise_max, self.noise + config.noise_boost), 0
        self.done = self.done or self.beta >= config.max_beta - 1e-8
        self.step += 1
        gaining = delta >= config.extend_beta > 0 or (config.patience > 0 and self.stale < config.patience)
        if not self.done and self.step == self.limit and config.extend_steps and self.limit < config.hard_max_steps and gaining:
            self.limit = min(config.hard_max_steps, self.limit + config.extend_steps)


def write_state(folder: str, now: DataFrame, best: DataFrame | None, at: _Scalars, told: dict) -> None:
    """The population of a step, the best one if it is new, then one row that tells that the step is complete."""
    spark = now.sparkSession
    now.write.mode("overwrite").parquet(f"{folder}/population/step={told['step']}")
    if best is not None:
        best.write.mode("overwrite").parquet(f"{folder}/best/step={told['step']}")
    row = [(told["step"], json.dumps(vars(at)), json.dumps(told))]
    spark.createDataFrame(row, "step long, scalars string, told string").write.mode("append").parquet(f"{folder}/steps")


def read_state(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, _Scalars, list[dict]] | None:
    """(population, best population, scalars, history) after the last complete step; None without one."""
    try:
        rows = spark.read.parquet(f"{folder}/steps").orderBy("step").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    at = _Scalars(**json.loads(rows[-1]["scalars"]))
    now = spark.read.parquet(f"{folder}/population/step={rows[-1]['step']}")
    best = spark.read.parquet(f"{folder}/best/step={at.best_step}") if at.best_step >= 0 else now
    return now, best, at, [json.loads(r["told"]) for r in rows]


def with_preset(name: str, **changes) -> AnnealConfig:
    return replace(PRESETS[name], **changes)


def history_frame(spark: SparkSession, result: AnnealResult) -> DataFrame:
    schema = "step long, beta double, delta_beta double, ess double, log_z double, branches long, noise double, mean double, max double, std double, n_unique long, n long"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(h[c] for c in names) for h in result.history], schema)
