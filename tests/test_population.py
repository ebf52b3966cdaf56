"""Kernel formulas against small numpy versions, and properties."""

import threading
import socket

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import schedule
from helixframe.functions import sequence as S
from helixframe.operators import archives, profiles, proposals, ranking, relational, resample
from helixframe.plans import anneal
from helixframe.sources import remote, sequences, sinks
from helixframe.streaming import archives as stream


def _systematic(w, u0, n):
    c = np.cumsum(w) / np.sum(w)
    c[-1] = 1
    at = np.clip(np.searchsorted(c, u0 + np.arange(n) / n), 0, len(w) - 1)
    return np.bincount(at, minlength=len(w))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_systematic_copies(spark, seed):
    rng = np.random.default_rng(seed)
    n, u0 = 37 + seed, rng.random()
    for w in (rng.integers(1, 1000, 60), rng.random(60)):
        df = spark.createDataFrame([(i, x.item(), i % 3) for i, x in enumerate(w)], f"pid long, w {'long' if w.dtype == int else 'double'}, g int")
        # u0 is in steps of 1/n.
        got = {r["pid"]: r["copies"] for r in resample.systematic_copies(df, "w", "pid", u0, n).collect()}
        assert [got[i] for i in range(60)] == _systematic(w.astype(float), u0 / n, n).tolist()
        got = {r["pid"]: r["copies"] for r in resample.systematic_copies(df, "w", "pid", u0, group="g").collect()}
        for g in range(3):
            assert [got[i] for i in range(g, 60, 3)] == _systematic(w[g::3].astype(float), u0 / 20, 20).tolist()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_wide_rows_are_all_numbered(spark, adaptive):
    """At 200 shuffle partitions adaptive execution deals narrow and wide jobs differently."""
    n = 300_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string")))), "")
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("pid"), F.lit(3).cast("long").alias("w"), F.pmod("id", F.lit(2)).alias("g"), wide.alias("seq"))
        rows = relational.numbered(df, "pid")
        assert rows.count() == n and rows.where("idx <> pid or length(seq) <> 256").isEmpty()
        rows = ranking.prefix_sum(df, "pid", "w", "c")
        assert rows.count() == n and rows.where("c <> 3 * (pid + 1)").isEmpty()
        rows = ranking.prefix_sum(df, "pid", "w", "c", "g")
        assert rows.count() == n and rows.groupBy("g").agg(F.max("c").alias("m"), F.count_distinct("c").alias("d")).where(f"m <> {3 * n // 2} or d <> {n // 2}").isEmpty()
        assert resample.systematic_copies(df, "w", "pid", 0.5).agg(F.sum("copies")).first()[0] == n
        assert relational.sample_with_replacement(df, 1000, "pid", 1).count() == 1000
        assert {r["half"]: r["count"] for r in relational.split_half(df, "pid").groupBy("half").count().collect()} == {"A": n // 2, "B": n // 2}
        pairs = df.select("pid", F.col("pid").cast("double").alias("s"), F.pmod("pid", F.lit(1000)).alias("e"), "seq")
        # Edits fall as scores rise only over the last thousand.
        assert ranking.pareto_first(pairs, "s", "e").count() == 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_largest_step_keeps_ess(spark):
    f = np.random.default_rng(1).normal(size=500)
    df = spark.createDataFrame(list(enumerate(f.tolist())), "pid long, f double")
    ess = lambda x: np.exp(x - x.max()).sum() ** 2 / np.exp(2 * (x - x.max())).sum()
    d = resample.largest_step(df, "f", 50.0, 0.5)
    assert 0 < d < 50 and ess(d * f) >= 250 - 1e-6 and ess((d + 1e-6) * f) < 250
    assert resample.largest_step(df.withColumn("f", F.lit(1.0)), "f", 3.0, 0.9) == 3.0


def test_quotas(spark):
    def quotas(mean, count, n, *more):
        rows = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(zip(mean, count, strict=True))], "bin int, mean double, n long")
        return [r["quota"] for r in resample.allotted(rows, n, *more).orderBy("bin").collect()]

    assert quotas([1.0, 2.0, 0.0], [5, 5, 0], 10) == [3, 7, 0]
    assert quotas([0.0, 0.0], [3, 3], 6) == [3, 3]
    assert quotas([1.0, 1.0], [3, 3], 5, "raw", 1.0, 3) == [2, 2]
    assert quotas([1.0, 3.0, -9.0], [5, 5, 0], 10, "minshift", 1.0, 1) == [1, 8, 1]
    share = np.exp([-0.5, 0.5])
    assert quotas([1.0, 2.0], [5, 5], 100, "exp") == [round(100 * x) for x in share / share.sum()]
    assert quotas([-1.0, -2.0, 5.0], [5, 5, 0], 9) == [3, 3, 3]


def test_average_rank_and_prefix_sum(spark):
    v = [3.0, 1.0, 3.0, 2.0, 1.0]
    df = spark.createDataFrame(list(enumerate(v)), "pid long, v double")
    got = {r["pid"]: r["r"] for r in ranking.with_average_rank(df, "v", "r").collect()}
    assert [got[i] for i in range(5)] == [4.5, 1.5, 4.5, 3.0, 1.5]
    run = {r["pid"]: r["c"] for r in ranking.prefix_sum(df, "pid", "v", "c").collect()}
    assert [run[i] for i in range(5)] == np.cumsum(v).tolist()


def test_pareto_fronts(spark):
    rng = np.random.default_rng(4)
    pts = rng.integers(0, 12, (60, 2))
    df = spark.createDataFrame([(i, float(s), int(e)) for i, (s, e) in enumerate(pts)], "pid long, s double, e long").toDF("pid", "score", "edits")
    left, want, front = set(range(60)), {}, 0
    while left:
        best = {i for i in left if not any(pts[j][0] >= pts[i][0] and pts[j][1] <= pts[i][1] and tuple(pts[j]) != tuple(pts[i]) for j in left)}
        want |= dict.fromkeys(best, front)
        left, front = left - best, front + 1
    got = {r["pid"]: r["front"] for r in ranking.pareto_fronts(df, "pid", "score", "edits").collect()}
    assert got == want
    first = {r["pid"] for r in ranking.pareto_first(df, "score", "edits").collect()}
    assert first == {i for i, f in want.items() if f == 0}
    fit = ranking.pareto_fitness(ranking.crowding(ranking.pareto_fronts(df, "pid", "score", "edits"), "score", "edits", "pid"))
    assert fit.where("pareto_fitness is null").count() == 0


def test_profile_correlation(spark):
    rows = spark.createDataFrame([(0, "ACGTACGTTGCA"), (1, "AAAAAAAAAAAA"), (2, "ACACACACGTGT")], "pid long, seq string")
    pool = profiles.pool_profile(rows)
    share = {r["kmer"]: r["share"] for r in pool.collect()}
    kmers = [r["kmer"] for r in profiles.dimension(spark).collect()]
    y = np.array([share.get(k, 0.0) for k in kmers])
    for r in profiles.correlation_with(rows, pool).join(rows, "pid").collect():
        x = np.array([sum(r["seq"][i : i + 3] == k for i in range(10)) for k in kmers], float)
        assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTTTGA",)], "seq string")
    one = lambda c: df.select(c).first()[0]
    assert one(S.reverse_complement("seq")) == "TCAAACGT"
    assert one(S.tokens("seq")) == [0, 1, 2, 3, 3, 3, 2, 0]
    assert one(S.kmer_indices("seq"))[0] == 6
    assert one(S.from_one_hot(S.one_hot("seq"))) == "01233320"
    assert one(S.roll("seq", 3)) == "TGAACGTT"
    assert one(S.motif_count("seq", "TT")) == 2
    assert one(S.hamming("seq", F.lit("ACGATTGA"))) == 1
    assert one(S.homopolymer("seq")) == 3
    assert one(S.cleaned(F.lit("acgn"), "as_A")) == "ACGA"
    assert one(S.cleaned(F.lit("acgn"), "drop")) is None
    with pytest.raises(Exception, match="unknown base"):
        one(S.cleaned(F.lit("acgn")))
    assert one(S.prefix_tokens(F.lit("101"), "seq"))[:4] == [8, 7, 8, 7]


def test_schedules():
    assert [schedule.branches("linear_2_8", 4, i, 5) for i in range(5)] == [2, 4, 5, 6, 8]
    assert [schedule.branches("late_2_9_50", 4, i, 4) for i in range(4)] == [2, 2, 9, 9]
    assert schedule.branches([3, 5], 4, 9, 10) == 5 and schedule.branches(None, 4, 0, 1) == 4
    assert schedule.branches("step_1_2_3", 4, 9, 10) == 3


def test_sampling_and_sets(spark):
    df = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") % 7).alias("g"), (F.col("id") % 5).cast("double").alias("v"))
    assert relational.sample_without_replacement(df, 10, "pid", 1).count() == 10
    assert relational.sample_with_replacement(df, 80, "pid", 1).count() == 80
    assert relational.top_k_or_fill(df, 60, "v", "pid", 1).count() == 60
    half = {r["half"]: r["count"] for r in relational.split_half(df, "pid").groupBy("half").count().collect()}
    assert half == {"A": 25, "B": 25}
    first = {r["g"]: r["pid"] for r in relational.distinct_first(df, "g", "pid").collect()}
    assert first == {i: i for i in range(7)}
    assert relational.top_k_per_group(df, 2, "g", "v", "pid").count() == 14
    assert resample.gc_balanced_source(spark, 40, 60, [0.2, 0.4, 0.6, 0.8], 3).groupBy("bin").count().where("count < 13").count() == 0


def test_budget_is_bounded_and_ordered(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("step"), F.col("id").alias("row_id"), (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    got = archives.budget(df, 12, ["a", "b"])
    assert got.count() == 12 and archives.budget(df, 0, ["a", "b"]).count() == 0


def test_branch_choice_reverts_and_tau(spark):
    rows = [(0, k, "AAAA" if k == 0 else "CCCC", "AAAT", "AAAT", float(k)) for k in range(2)]
    df = spark.createDataFrame(rows, "pid long, k int, seq string, parent string, origin string, score double")
    assert proposals.chosen_branch(df, "score", 4).first()["seq"] == "CCCC"
    assert proposals.chosen_branch(df, "score", 4, cap=1).first()["seq"] == "AAAA"
    assert proposals.chosen_branch(df, "score", 4, cap=0).first()["seq"] == "AAAT"
    assert proposals.chosen_branch(df, "score", 4, tau=1.0, seed=3).first()["seq"] in ("AAAA", "CCCC")


def test_anneal_raises_fitness(spark):
    seeds = resample.uniform_source(spark, 64, 40, 5).select(F.col("slot").alias("pid"), "seq")
    run = anneal.anneal(seeds, proposals.MotifScorer("GA"), anneal.with_preset("toy", max_steps=3, branches=3, seed=2))
    start = proposals.MotifScorer("GA").score(seeds).agg(F.avg("score")).first()[0]
    assert run.population.count() == 64 and run.history[-1]["mean"] > start and run.history[-1]["n_unique"] > 1
    assert all(1 <= h["ess"] <= 64.001 for h in run.history)


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.dayofyear("ts").alias("step"), "user_id", "event_id", "value")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    archive = stream.Archive(str(tmp_path / "top"), stream.top_distinct_merge(8, "user_id", "value"))
    archive.start(live, str(tmp_path / "cp")).awaitTermination()
    want = archives.top_distinct(rows, 8, "user_id", "value")
    assert sorted(map(tuple, archive.read(spark).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_remote_scorer(spark):
    server = socket.create_server(("127.0.0.1", 0))
    score = lambda seqs: [s.count("G") for s in seqs]

    def loop():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            threading.Thread(target=remote.serve, args=(c, 6, score), daemon=True).start()

    threading.Thread(target=loop, daemon=True).start()
    df = spark.createDataFrame([("ACGGGT",), ("AAAAAA",)], "seq string")
    got = {r["seq"]: r["score"] for r in remote.score_remote(df, ("127.0.0.1", server.getsockname()[1])).collect()}
    server.close()
    assert got == {"ACGGGT": 3.0, "AAAAAA": 0.0}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGT", 0.5), (2, "GGGG", None)], "idx long, sequence string, K562 double")
    sinks.write_csv(df, str(tmp_path / "a.csv"))
    assert sequences.read_table(spark, str(tmp_path / "a.csv"), "idx long, sequence string, K562 double").count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        sequences.read_table(spark, str(tmp_path / "a.csv"), columns=["nope"])
    assert relational.drop_incomplete(df, ["K562"]).count() == 1
    assert sequences.rows_between(df, "idx", "2:").count() == 1
    (tmp_path / "r.json").write_text('{"K562": {"min": -1.0, "max": 2.0, "mean": 0.1}}')
    assert sequences.read_ranges(spark, str(tmp_path / "r.json"), ["K562"]).first()["max"] == 2.0
    sinks.write_archives({"a": df, "b": df.drop("K562")}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "archives")).groupBy("archive").count().count() == 2
    assert sinks.resume_step(spark, str(tmp_path / "none")) == 0
    assert "—" in sinks.markdown(df)
    with pytest.raises(Exception, match="adapter"):
        relational.require_known_orientation(df.withColumnRenamed("sequence", "seq")).collect()
