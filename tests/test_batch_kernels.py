"""What works on whole batches against the plain form, and what must not grow with the table."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import digests, rng
from helixframe.operators import mutagenesis, profiles, proposals, relational, resample
from helixframe.plans import catalog
from helixframe.sources import hdf5


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digests_are_md5():
    heads, tails = [b"", b"9:mask:7:0:0:", b"9:mask:1000000:0:0:", b"x" * 53, b"y" * 80], [str(i).encode() for i in (0, 9, 10, 123)]
    got = digests.every(heads, tails, 4)
    for r, h in enumerate(heads):
        for c, t in enumerate(tails):
            assert (got[r, c] == np.frombuffer(hashlib.md5(h + t).digest(), ">u4")).all()
    row, which = np.divmod(np.arange(20), 4)
    assert (digests.some(heads, tails, row, which) == got[:, :, 0].reshape(-1)).all()


@pytest.mark.parametrize("more", [{}, {"shared": True}, {"exact": True}, {"rates": (0.1, 0.6)}])
def test_masked_draws_are_those_of_the_column_prng_and_need_no_expression_a_base(spark, more):
    df = resample.uniform_source(spark, 20, 30, 3).select(F.col("slot").alias("pid"), "seq")
    made = proposals.Masked(0.2, 7, **more).expand(df.withColumn("parent", F.col("seq")), 2, 4)
    assert "transform(split" not in _plan(made.select("seq", "parent"))
    u = lambda s, *k: int(hashlib.md5(":".join(map(str, (7, s, *k))).encode()).hexdigest()[:8], 16) / 2**32
    for r in made.collect():
        keys = (r["pid"], 4) if more.get("shared") else (r["pid"], r["k"], 4)
        rate = more["rates"][int(u("kernel", r["pid"], 4) * 2)] if "rates" in more else 0.2
        draws = [u("mask", *keys, i) for i in range(30)]
        hit = set(sorted(range(30), key=lambda i: (draws[i], i))[:6]) if more.get("exact") else {i for i in range(30) if draws[i] < rate}
        assert r["seq"] == "".join("ACGT"[int(u("base", r["pid"], r["k"], 4, i) * 4)] if i in hit else c for i, c in enumerate(r["parent"]))


def test_masked_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ACGT")], "pid long, seq string")
    got = {r["pid"]: r["seq"] for r in proposals.Masked(1.0, 1).expand(df, 1, 0).collect()}
    assert got[1] is None and got[2] == "" and len(got[3]) == 4


def test_weighted_draws_look_ahead_over_a_growing_frame(spark):
    df = spark.range(3000).select(F.col("id").alias("pid"), (F.col("id") % 7).alias("w"))
    got = resample.weighted_draws(df, 500, "w", "pid", 3)
    assert "unboundedfollowing" not in _plan(got).lower()
    upto = np.cumsum(np.arange(3000) % 7)
    word = lambda s, d: int(hashlib.md5(f"3:{s}:{d}".encode()).hexdigest()[:8], 16)
    for r in got.collect():
        point = (word("weighted-high", r["draw"]) // 2 * 2**32 + word("weighted-low", r["draw"])) % int(upto[-1])
        assert r["pid"] == int(np.searchsorted(upto, point, "right"))


def test_sequence_profiles_shuffle_sequences_not_kmers(spark):
    rows = [(1, "ACGTACGT"), (1, "ACG"), (2, "AC"), (None, "GGGG"), (None, "GGGT"), (3, None)]
    df = spark.createDataFrame(rows, "pid long, seq string").repartition(3)
    told = profiles.sequence_profile(df)
    assert "explode" not in _plan(told).lower()
    want = {}
    for key in {k for k, _ in rows}:
        texts = [s for k, s in rows if k == key and s]
        for kmer in (s[i : i + 3] for s in texts for i in range(len(s) - 2)):
            want[key, kmer] = want.get((key, kmer), 0) + 1 / (max(map(len, texts)) - 2)
    assert {(r["pid"], r["kmer"]): pytest.approx(r["share"]) for r in told.collect()} == want


def test_candidate_bounds_write_no_candidates(spark, sf):
    texts = ["ACGT", "AAAA", "TTTT", "A", "T", "G", "AAAN", "TTTZ", "NNNN", "CAAA", "TTTA", "", None, "A-A"]
    df = spark.createDataFrame(list(enumerate(texts)), "pid long, seq string")
    every = mutagenesis.with_candidates(df).withColumn("e", F.col("candidates.candidate"))
    want = {r["pid"]: (r["n"], r["a"], r["b"]) for r in every.select("pid", F.size("e").alias("n"), F.array_min("e").alias("a"), F.array_max("e").alias("b")).collect()}
    assert {r["pid"]: (r["candidates"], r["first"], r["last"]) for r in mutagenesis.candidate_bounds(df).collect()} == want
    assert "array_min" not in _plan(catalog.QUERIES["ism_candidates"](spark, sf))


@pytest.mark.parametrize("down", [True, False])
def test_large_top_k_is_no_sorted_limit(spark, monkeypatch, down):
    monkeypatch.setattr(relational, "ONE_TASK", 5, raising=False)
    nan = float("nan")
    rows = [(i, v) for i, v in enumerate([3.0, None, nan, 1.0, 3.0, 3.0, -1.0, nan, None, 0.0, -0.0, 2.0] * 3)]
    df = spark.createDataFrame(rows, "pid long, v double")
    pick = relational.top_k if down else relational.bottom_k
    for k in (6, 10, 20, 33, 36, 50):
        order = [F.desc("v") if down else F.asc("v"), "pid"]
        want = sorted(r["pid"] for r in df.orderBy(*order).limit(k).collect())
        got = pick(df, k, "v", "pid")
        assert "TakeOrdered" not in _plan(got)
        assert sorted(r["pid"] for r in got.collect()) == want


@pytest.mark.parametrize("key", ["indices", "arr_0"])
def test_a_task_holds_one_file_of_a_pool_at_a_time(spark, tmp_path, monkeypatch, key):
    monkeypatch.setattr(hdf5, "FILE_ROWS", 16, raising=False)
    df = resample.uniform_source(spark, 100, 20, 3).select(F.col("slot").alias("pid"), "seq").coalesce(1)
    hdf5.write_pool(df, str(tmp_path / "pool"), key)
    # Workers import the module anew, with its own number of rows; a task's rows are in order over its files.
    assert [n[:10] for n in sorted(os.listdir(tmp_path / "pool"))][0] == "part-00000" and all(n.count("-") == 2 for n in os.listdir(tmp_path / "pool"))
    got = {r["pid"]: r["seq"] for r in hdf5.read_pool(spark, str(tmp_path / "pool")).collect()}
    assert got == {r["pid"]: r["seq"] for r in df.collect()}


def test_likelihood_sums_what_the_prng_masks(spark):
    df = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "AC"), (3, None)], "pid long, seq string")
    counts = {"ACG": 5, "CGT": 2}
    got = {r["pid"]: r["score"] for r in proposals.NeighbourLikelihood(counts, 0.5, 2).score(df).collect()}
    n = lambda k: counts.get(k, 0) + 1
    s = "ACGTACGTAC"
    masked = [i for i in range(1, 9) if int(hashlib.md5(f"2:ppl:1:{i}".encode()).hexdigest()[:8], 16) / 2**32 < 0.5]
    assert got[1] == pytest.approx(sum(np.log(n(s[i - 1 : i + 2]) / sum(n(s[i - 1] + b + s[i + 1]) for b in "ACGT")) for i in masked))
    assert got[3] is None and rng.tails(2) == [b"0", b"1"]
