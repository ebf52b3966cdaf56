"""Annealing by blocks against the general form, and the draws of sparse proposals against plain ones."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import draws
from helixframe.operators import proposals, resample
from helixframe.plans import anneal, blocks

M = 2**64 - 1


def _mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def _plain(seq, rate, seed, step, pid, k):
    at = int.from_bytes(hashlib.md5(f"{seed}:sparse:{step}".encode()).digest()[:8], "big")
    for x in (pid, k):
        at = _mixed(at + (x + 1) * 0x9E3779B97F4A7C15 & M)
    out, place, j = list(seq), -1, 0
    while rate:
        j += 1
        word = _mixed(at + j * 0x9E3779B97F4A7C15 & M)
        left = 1.0
        for _ in range(len(seq)):
            left *= 1.0 - rate
            if (word >> 32) >= math.floor(left * 2**32):
                break
            place += 1
        place += 1
        if place >= len(seq):
            break
        out[place] = "ACGT"[word & 3]
    return "".join(out)


@pytest.fixture(scope="module")
def pool(spark):
    return resample.uniform_source(spark, 60, 42, 3).select((F.col("slot") * 7).alias("pid"), "seq")


@pytest.mark.parametrize("rate", [0.0, 0.03, 0.4, 1.0])
def test_sparse_draws_are_the_plain_ones(pool, rate):
    for r in proposals.Sparse(rate, 9).expand(pool.withColumn("parent", F.col("seq")), 3, 5).collect():
        assert r["seq"] == _plain(r["parent"], rate, 9, 5, r["pid"], r["k"])


def test_sparse_draws_redraw_each_place_alike():
    grid = np.zeros((40_000, 50), np.uint8)
    draws.redraw(grid, draws.stems(draws.key(1, "s"), np.arange(40_000)), 0.1, np.frombuffer(b"ACGT", np.uint8))
    hit = grid > 0
    assert np.abs(hit.mean(0) - 0.1).max() < 0.008 and hit.sum(1).var() == pytest.approx(50 * 0.09, rel=0.05)
    assert np.abs(np.corrcoef(hit.T) - np.eye(50)).max() < 0.03
    assert np.abs(np.bincount(grid[hit])[[65, 67, 71, 84]] / hit.sum() - 0.25).max() < 0.005


def test_sparse_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ACGT")], "pid long, seq string")
    got = {r["pid"]: r["seq"] for r in proposals.Sparse(1.0, 1).expand(df, 1, 0).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 4


@pytest.mark.parametrize("motif", ["GA", "AA", "G", "ACGTACGTACGT" * 4])
def test_values_of_a_motif_are_its_scores(pool, motif):
    scorer = proposals.MotifScorer(motif)
    rows = scorer.score(pool).collect()
    letters = np.frombuffer("".join(r["seq"] for r in rows).encode(), np.uint8).reshape(len(rows), -1)
    assert scorer.values(letters).tolist() == [r["score"] for r in rows]


def test_packed_bases_come_back():
    for length in (1, 4, 7, 200):
        letters = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(length).integers(0, 4, (9, length))]
        assert (blocks.unpacked(blocks.packed(letters), length) == letters).all()


def _same(ours, theirs):
    assert len(ours.history) == len(theirs.history) and ours.best_step == theirs.best_step
    for a, b in zip(ours.history, theirs.history, strict=True):
        assert a == pytest.approx(b)
    for x, y in ((ours.population, theirs.population), (ours.best_population, theirs.best_population)):
        assert sorted(map(tuple, x.select("pid", "seq", "origin", "fitness", "log_p").collect())) == sorted(map(tuple, y.select("pid", "seq", "origin", "fitness", "log_p").collect()))


def test_blocks_give_the_rows_of_the_general_form(spark, pool):
    config = anneal.with_preset("toy", max_steps=5, branches=3, noise_end=0.2, temperature=1.5, seed=2)
    _same(anneal.anneal(pool, proposals.MotifScorer("GA"), config), anneal.anneal(pool, proposals.MotifScorer("GA"), config, proposal=proposals.Sparse))


def test_a_step_by_blocks_takes_few_jobs(spark, pool):
    spark.sparkContext.setJobGroup("blocks", "annealing")
    run = anneal.anneal(pool, proposals.MotifScorer("GA"), anneal.with_preset("toy", max_steps=4, seed=2))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("blocks"))
    spark.sparkContext.setJobGroup("others", "")
    # What comes before the first step takes some ten.
    assert jobs <= 12 + 6 * len(run.history)


def test_blocks_with_many_values_and_other_letters_than_bases(spark, pool):
    predict = lambda seqs: np.array([(np.frombuffer(s.encode(), np.uint8).astype(float) @ np.sqrt(np.arange(1, len(s) + 1))) / 1000 for s in seqs])
    many = resample.uniform_source(spark, 8 * blocks.FEW, 21, 3).select(F.col("slot").alias("pid"), "seq")
    config, scorer = anneal.with_preset("toy", max_steps=3, branches=2, seed=2), proposals.PandasScorer(predict)
    values = lambda letters: (letters.astype(float) @ np.sqrt(np.arange(1, letters.shape[1] + 1))) / 1000
    scorer.values = values
    assert blocks.Blocks.of(many, values).values is None
    ours, theirs = anneal.anneal(many, scorer, config), anneal.anneal(many, scorer, config, proposal=proposals.Sparse)
    for a, b in zip(ours.history, theirs.history, strict=True):
        assert a == pytest.approx(b)
    assert sorted(r["seq"] for r in ours.population.collect()) == sorted(r["seq"] for r in theirs.population.collect())
    strange = pool.withColumn("seq", F.when(F.col("pid") == 7, F.lit("N" * 42)).otherwise(F.col("seq")))
    assert blocks.Blocks.of(strange, values) is None and blocks.Blocks.of(pool.limit(0), values) is None


def test_a_row_that_takes_all_copies_is_dealt_over_tasks(spark, pool):
    hot = pool.withColumn("seq", F.when(F.col("pid") == 70, F.lit("GA" * 21)).otherwise(F.col("seq")))
    values = proposals.MotifScorer("GA").values
    told = []
    for size in (4, 4096):
        start = blocks.Blocks.of(hot, values, size)
        weighed, whole, _, _, sums = start.weighed(5.0, start.best(), 1.0)
        then = start.grown(weighed, whole, sums, 0.5, values, 0.02, 1, 2, 0)
        told.append(sorted(map(tuple, then.rows(start).collect())))
        assert sum(n for _, n, _ in then.blocks) == 60 and max(n for _, n, _ in then.blocks) <= size
        if size == 4:
            assert len({task for *_, task in then.blocks}) > 1
    assert told[0] == told[1] and len({r[2] for r in told[0]}) == 1 and [r[0] for r in told[0]] == list(range(60))


def test_n_unique_counts_over_all_tasks(spark, pool):
    twice = pool.unionByName(pool.where("pid < 70").withColumn("pid", F.col("pid") + 1000)).repartition(4, "pid")
    assert blocks.Blocks.of(twice, proposals.MotifScorer("GA").values, 8).n_unique() == 60
