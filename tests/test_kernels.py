"""Sampler kernels, searches, scorers and sinks against plain versions on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import archives, profiles, proposals, ranking, relational, resample
from helixframe.plans import anneal
from helixframe.sources import sequences, sinks


def _u(seed, stream, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, stream, *keys))).encode()).hexdigest()[:8], 16) / 2**32


def _ham(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def pool(spark):
    return resample.uniform_source(spark, 60, 40, 5).select(F.col("slot").alias("pid"), "seq").cache()


def _counter():
    """A scorer that travels to workers by value."""

    def count(seqs):
        return np.array([sum(s.startswith("GA", i) for i in range(len(s))) for s in seqs], float)

    return count


_gata = _counter()


def test_softmax_selection_draws_by_hash(spark):
    rows = [(p, k, "ACGT"[k] * 4, "AAAT", "AAAT", float(k)) for p in range(40) for k in range(4)]
    df = spark.createDataFrame(rows, "pid long, k int, seq string, parent string, origin string, score double")
    got = {r["pid"]: (r["seq"], r["log_p"]) for r in proposals.chosen_branch(df, "score", 4, tau=0.7, seed=3, step=2).collect()}
    w = np.exp((np.arange(4) - 3) / 0.7)
    up = np.cumsum(w) / w.sum()
    for p in range(40):
        k = int(np.argmax(up > _u(3, "tau", p, 2)))
        assert got[p][0] == "ACGT"[k] * 4 and got[p][1] == pytest.approx(np.log(w[k] / w.sum()))
    assert len({s for s, _ in got.values()}) > 1


def test_exact_mask_and_mixture(spark, pool):
    rows = {r["pid"]: r["seq"] for r in pool.collect()}
    fixed = proposals.Masked(0.1, 4, exact=True).expand(pool, 2, 1).collect()
    for r in fixed:
        order = sorted(range(40), key=lambda i: (_u(4, "mask", r["pid"], r["k"], 1, i), i))[:4]
        want = [("ACGT"[int(_u(4, "base", r["pid"], r["k"], 1, i) * 4)] if i in order else c) for i, c in enumerate(rows[r["pid"]])]
        assert r["seq"] == "".join(want)
    for r in proposals.Masked(0.0, 4, shared=True, rates=(0.0, 0.9)).expand(pool, 1, 2).collect():
        if int(_u(4, "kernel", r["pid"], 2) * 2) == 0:
            assert r["seq"] == rows[r["pid"]]
        else:
            assert _ham(r["seq"], rows[r["pid"]]) > 10


def test_branch_tokens_climb(spark, pool):
    grown = proposals.Masked(0.2, 4).expand(pool.withColumns({"parent": F.col("seq"), "origin": F.col("seq")}), 3, 0)
    grown = grown.withColumn("score", S.motif_count("seq", "GA").cast("double")).cache()
    for cap, total in ((0, None), (9, 10)):
        got = {r["pid"]: r for r in proposals.branch_tokens_climb(grown.repartition(3), _counter(), step_cap=cap, total_cap=total).collect()}
        by = {}
        for r in grown.collect():
            by.setdefault(r["pid"], []).append(r)
        for pid, rows in by.items():
            rows.sort(key=lambda r: r["k"])
            best = max(rows, key=lambda r: (r["score"], -r["k"]))
            now, value, swaps = best["seq"], best["score"], 0
            shown = [[r["seq"][i] for r in rows] for i in range(40)]
            for at in sorted((i for i in range(40) if len(set(shown[i])) > 1), key=lambda i: (-len(set(shown[i])), i)):
                if cap and _ham(now, best["parent"]) >= cap:
                    break
                trials = [(b, now[:at] + b + now[at + 1 :]) for b in dict.fromkeys(shown[at]) if b != now[at]]
                v, new = max(((float(_gata([t])[0]), t) for _, t in trials), key=lambda x: x[0])
                if v > value and (total is None or _ham(new, best["origin"]) <= total):
                    now, value, swaps = new, v, swaps + 1
            assert (got[pid]["seq"], got[pid]["score"], got[pid]["swaps"]) == (now, value, swaps)


@pytest.mark.parametrize("mode", ["ucb", "uniform"])
def test_tree_search(spark, pool, mode):
    predict = _counter()
    first = {r["pid"]: float(_gata([r["seq"]])[0]) for r in pool.collect()}
    a = proposals.tree_search(pool.repartition(4), predict, 5, 3, 0.1, 1, depth=2, mode=mode).collect()
    b = proposals.tree_search(pool.coalesce(1), predict, 5, 3, 0.1, 1, depth=2, mode=mode).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 60
    assert all(r["score"] == _gata([r["seq"]])[0] for r in a)
    assert np.mean([r["score"] for r in a]) > np.mean(list(first.values()))
    # One level deep, a tree is its root and one round's children.
    one = proposals.tree_search(pool, predict, 9, 3, 0.1, 1, depth=1, mode=mode).collect()
    two = proposals.tree_search(pool, predict, 1, 3, 0.1, 1, mode=mode).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_surrogate_is_ridge(spark, pool):
    rows = pool.withColumn("y", S.motif_count("seq", "GA").cast("double")).collect()
    df = spark.createDataFrame(rows)
    w = proposals.ridge_surrogate(df.repartition(3), "y", alpha=2.0)
    names = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    x = np.array([[sum(r["seq"].startswith(k, i) for i in range(40)) for k in names] for r in rows], float)
    y = np.array([r["y"] for r in rows])
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(64), xc.T @ (y - y.mean()))
    assert np.abs(w[:-1] - want).max() < 1e-8 and w[-1] == pytest.approx(y.mean() - x.mean(0) @ want)
    got = df.select(proposals.surrogate_score(w).alias("s"), "seq").collect()
    assert all(r["s"] == pytest.approx(w[-1] + sum(w[names.index(r["seq"][i : i + 3])] for i in range(38))) for r in got)


def test_scorers(spark, pool):
    grown = proposals.Masked(0.2, 1).expand(pool, 4, 0)
    motif = proposals.MotifScorer("GA")
    best = proposals.cascade(grown, proposals.CellScorer(("c1",)), motif, 2, "score_c1")
    assert best.groupBy("pid").count().where("count <> 2").isEmpty() and "score" in best.columns
    kept = proposals.prefiltered(proposals.CellScorer(("c1",)).score(grown), 1, "score_c1")
    top = grown.withColumn("c", proposals.cell_scores()["c1"]).groupBy("pid").agg(F.max("c").alias("m"))
    assert kept.join(top, "pid").where("score_c1 <> m").isEmpty() and kept.count() == 60
    memo = motif.score(pool.limit(20)).select("seq", "score")
    scored, memo = proposals.remembered(pool, memo, motif)
    assert memo.count() == 60 and scored.join(motif.score(pool).select("pid", F.col("score").alias("s")), "pid").where("score <> s").isEmpty()
    check = proposals.sampled_check(motif.score(pool).withColumnRenamed("score", "known"), motif, "known", 10, 1).first()
    assert (check["n"], check["largest"]) == (10, 0.0)
    counts = {r["kmer"]: r["n"] for r in profiles.kmer_counts(pool, "seq", 3, []).collect()}
    two = proposals.mean_likelihood(pool, counts, [0.1, 0.3], 5).collect()
    parts = [{r["pid"]: r["score"] for r in proposals.NeighbourLikelihood(counts, rate, 5 + i).score(pool).collect()} for i, rate in enumerate((0.1, 0.3))]
    assert all(r["approx_ll"] == pytest.approx((parts[0][r["pid"]] + parts[1][r["pid"]]) / 2) for r in two) and min(parts[1].values()) < 0


def test_copy_cap_and_rejuvenation(spark):
    rows = [(i, c, 1.0 + i) for i, c in enumerate([9, 0, 2, 1, 0, 8])]
    df = spark.createDataFrame(rows, "pid long, copies long, weight double")
    got = {r["pid"]: r["copies"] for r in resample.capped(df, 4, "weight", "pid", 3).collect()}
    assert sum(got.values()) == 20 and got[1] == got[4] == 0 and got[0] == got[5] == 4 and got[2] + got[3] == 12
    full = {r["pid"]: r["copies"] for r in resample.capped(df.where("copies > 2"), 4, "weight", "pid", 3).collect()}
    assert sum(full.values()) == 17
    low = spark.createDataFrame([(i, f"s{i}", f"o{i}", float(i)) for i in range(10)], "pid long, seq string, origin string, fitness double")
    fresh = spark.createDataFrame([(i, f"n{i}", 50.0) for i in range(9)], "slot long, seq string, fitness double")
    out = {r["pid"]: (r["seq"], r["origin"], r["fitness"]) for r in resample.rejuvenated(low, fresh, 0.25, "fitness").collect()}
    assert out == {0: ("n0", "n0", 50.0), 1: ("n1", "n1", 50.0)} | {i: (f"s{i}", f"o{i}", float(i)) for i in range(2, 10)}


def test_swaps_keep_both_rows(spark):
    df = spark.createDataFrame([(i, f"s{i}", i // 3) for i in range(6)], "pid long, seq string, island int")
    old = {r["pid"]: (r["seq"], r["origin"]) for r in resample.swapped(df.withColumn("origin", F.concat(F.lit("o"), "pid")), [(1, 4)]).collect()}
    assert old == {i: (f"s{ {1: 4, 4: 1}.get(i, i)}", f"o{i}") for i in range(6)}
    assert resample.swap_map([(1, 0.0), (4, 9.0)], [1.0, 3.0], 2.0, [0.5]) == [(1, 4)]
    assert resample.swap_map([(1, 9.0), (4, 0.0)], [1.0, 3.0], 2.0, [0.5]) == []
    got = {r["pid"]: (r["seq"], r["island"]) for r in resample.swapped(df, [(1, 4)]).collect()}
    assert got == {0: ("s0", 0), 1: ("s4", 0), 2: ("s2", 0), 3: ("s3", 1), 4: ("s1", 1), 5: ("s5", 1)}


def test_near_duplicates(spark, pool):
    rows = {r["pid"]: r["seq"] for r in pool.collect()}
    close = spark.createDataFrame([(100, "T" + rows[0][1:]), (101, rows[1])], "pid long, seq string")
    got = {r["pid"] for r in relational.near_duplicates(pool.unionByName(close), 3, 62, 40, 1).where("near").collect()}
    assert got == {0, 1, 100, 101}
    with pytest.raises(ValueError):
        relational.distances_to(pool, spark.range(relational.QUERY_ROWS + 1).select(F.col("id").alias("pid"), F.lit("A").alias("seq")))


def test_anneal_with_islands_spread_memo_and_surrogate(spark, pool):
    config = anneal.with_preset(
        "toy", max_steps=3, branches=4, islands=3, temperatures=(1.0, 2.0, 4.0), spread_below=4, memo=True, surrogate_keep=2, tau=0.5, branch_correction=True, rejuvenate_share=0.05, max_copies=6, elite_share=0.1, seed=4
    )
    run = anneal.anneal(pool, proposals.MotifScorer("GA"), config)
    last = run.population.collect()
    assert len(last) == 60 and {r["pid"] for r in last} == set(range(60))
    assert all(r["fitness"] == _gata([r["seq"]])[0] for r in last)
    assert run.history[-1]["mean"] > np.mean(_gata([r["seq"] for r in pool.collect()]))


def test_anneal_resumes(spark, pool, tmp_path):
    config = anneal.with_preset("toy", max_steps=4, branches=2, seed=2)
    whole = anneal.anneal(pool, proposals.MotifScorer("GA"), config)
    part = anneal.anneal(pool, proposals.MotifScorer("GA"), anneal.with_preset("toy", max_steps=2, branches=2, seed=2), state=str(tmp_path / "run"))
    assert len(part.history) == 2
    # The first run's limit is part of its state; a longer one goes on from there.
    now, best, at, told = anneal.read_state(spark, str(tmp_path / "run"))
    assert (at.step, len(told), now.count()) == (2, 2, 60)
    at.limit = 4
    anneal.write_state(str(tmp_path / "more"), now, best, at, told[-1] | {"step": at.best_step})
    now.write.parquet(str(tmp_path / "more" / "population" / f"step={told[-1]['step']}x"))
    rest = anneal.anneal(pool, proposals.MotifScorer("GA"), config, state=str(tmp_path / "more"))
    assert rest.history[-1]["mean"] == pytest.approx(whole.history[-1]["mean"]) and rest.history[-1]["beta"] == pytest.approx(whole.history[-1]["beta"])
    assert sorted(r["seq"] for r in rest.population.collect()) == sorted(r["seq"] for r in whole.population.collect())


def test_budget_follows_its_checkpoints(spark):
    rows = [(s, s * 20 + i, float((i * 7 + s) % 13), float((i * 5) % 11)) for s in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "step long, row_id long, a double, b double")

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    kept: list = []
    for s in range(4):
        kept += [r for r in rows if r[0] == s]
        if len(kept) > 25:
            total = np.add(ranks([r[2] for r in kept]), ranks([r[3] for r in kept]))
            order = sorted(range(len(kept)), key=lambda i: (-total[i], kept[i][1]))
            kept = [kept[i] for i in order[:25]]
    assert sorted(r["row_id"] for r in archives.budget(df, 25, ["a", "b"]).collect()) == sorted(r[1] for r in kept)


def test_quantiles(spark):
    v = np.random.default_rng(1).integers(0, 30, 200) / 4
    df = spark.createDataFrame([(i, float(x), i % 3) for i, x in enumerate(v)] + [(900, None, 1)], "pid long, v double, g int")
    got = ranking.quantiles(df, "v", {"a": 0.37, "b": 0.95}).first()
    assert got["a"] == pytest.approx(np.quantile(v, 0.37)) and got["b"] == pytest.approx(np.quantile(v, 0.95))
    for r in ranking.quantiles(df, "v", {"a": 0.5}, "g").collect():
        assert r["a"] == pytest.approx(np.quantile(v[r["g"] :: 3], 0.5))


def test_populations_columns_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "AC", 0.5), (2, "GG", 0.1)], "pid long, seq string, score double")
    run = str(tmp_path / "run")
    sinks.write_population(df, run, "final", seed=3)
    assert spark.read.parquet(f"{run}/final").count() == 2 and '"seed": 3' in spark.read.parquet(f"{run}/final_meta").first()["meta"]
    better = df.withColumn("score", F.col("score") + 0.02)
    assert not sinks.write_best(df, df.withColumn("score", F.col("score") + 0.005), run, "score")
    assert sinks.write_best(df, better, run, "score") and spark.read.parquet(f"{run}/best").count() == 2
    more = spark.createDataFrame([(2, 9.0, "x")], "pid long, score double, tag string")
    assert {r["pid"]: (r["score"], r["tag"]) for r in sinks.with_columns_from(df, more, "pid").collect()} == {1: (None, None), 2: (9.0, "x")}
    sinks.write_csv(df.withColumn("cell", F.lit("a")), f"{run}/csv", by="cell")
    assert spark.read.csv(f"{run}/csv/cell=a", header=True).count() == 2
    made = []
    for _ in range(2):
        assert sinks.cached(spark, f"{run}/stats", lambda: made.append(1) or df).count() == 2
    assert len(made) == 1
    steps = spark.createDataFrame([(s, q, v) for s, q, v in ((1, "A", 0.9), (2, "A", 0.9), (2, "C", 0.6), (1, "C", 0.55), (3, "G", 0.2))], "step long, seq string, score double")
    sinks.write_threshold_archive(steps, f"{run}/archive", 0.5)
    assert [tuple(r) for r in spark.read.parquet(f"{run}/archive").select("seq", "score", "step").orderBy(F.desc("score")).collect()] == [("A", 0.9, 1), ("C", 0.6, 2)]
    best = archives.best_snapshot(steps, "score")
    assert {r["step"] for r in best.collect()} == {2}


def test_logit_mask_and_random_pool(spark):
    mask = spark.range(1).select(S.logit_mask(13, 7, "CT").alias("m")).first()["m"]
    assert [i for i, x in enumerate(mask) if x == 0.0] == [8, 10] and mask[7] == float("-inf")
    pool = sequences.seed_pool("random", n=20, length=30, seed=2, spark=spark)
    assert pool.count() == 20 and pool.where("length(seq) <> 30").isEmpty()


def test_weighted_draws(spark):
    w = [0, 5, 1, 0, 30, 2, 0, 7, 0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(w)], "pid long, w long")
    got = sorted((r["draw"], r["pid"]) for r in resample.weighted_draws(df, 3000, "w", "pid", 4).collect())
    assert [d for d, _ in got] == list(range(3000))
    share = np.bincount([p for _, p in got], minlength=len(w)) / 3000
    assert all(share[i] == 0 for i, x in enumerate(w) if not x) and np.abs(share - np.array(w) / sum(w)).max() < 0.03
    assert got == sorted((r["draw"], r["pid"]) for r in resample.weighted_draws(df.repartition(7), 3000, "w", "pid", 4).collect())
    assert resample.weighted_draws(df, 0, "w", "pid", 4).count() == resample.weighted_draws(df.where("w = 0"), 9, "w", "pid", 4).count() == 0


def test_budget_by_group(spark):
    rows = [(g, s, g * 1000 + s * 20 + i, float((i * 7 + s + g) % 13), float((i * 5) % 11)) for g in range(3) for s in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "run long, step long, row_id long, a double, b double")
    together = archives.budget(df, 25, ["a", "b"], group="run")
    for g in range(3):
        alone = archives.budget(df.where(F.col("run") == g), 25, ["a", "b"])
        assert sorted(r["row_id"] for r in together.where(F.col("run") == g).collect()) == sorted(r["row_id"] for r in alone.collect())
    assert archives.budget(df.limit(0), 5, ["a"]).count() == 0


@pytest.mark.parametrize("folded, block", [(0, 10_000), (0, 150), (0, 0), (120, 100)])
def test_budget_of_large_checkpoints_sees_candidates_only(spark, folded, block):
    """By blocks of candidates, by single ranked checkpoints and by small checkpoints together: as in one task."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(6):
        for i in range((300, 3, 90, 700, 40, 200)[s]):
            a = None if i % 41 == 0 else float("nan") if i % 43 == 0 else float(np.round(rng.normal(s % 3), 1 if s % 2 else 6))
            rows.append((s if s else None, s * 1000 + int(i), a, float(rng.integers(0, 5)) if s != 2 else float(-i), f"x{i}"))
    df = spark.createDataFrame(rows, "step long, row_id long, a double, b double, text string").repartition(5)
    want = sorted((r["row_id"], r["text"]) for r in archives.budget(df, 12, ["a", "b"]).collect())
    got = archives.budget(df, 12, ["a", "b"], folded=folded, block=block)
    assert got.columns == df.columns and sorted((r["row_id"], r["text"]) for r in got.collect()) == want and len(want) == 12


def test_budget_of_one_large_checkpoint_has_few_candidates(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(0).cast("long").alias("_t"), F.col("id").alias("_key"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("_s0"), (F.col("id") % 17).cast("double").alias("_s1"), F.col("id").alias("_id"))
    ranks = archives.ranking.rank_sum(df, ["_s0", "_s1"], "_rank").select("_id", "_rank")
    told = archives._with_reach(df, ["_s0", "_s1"], 1).join(ranks, "_id")
    assert told.where("_low <= _rank and _rank <= _high").count() == n
    assert told.where("_high - _low > 300").count() == 0


def test_fitness_stays_the_scorers_under_a_diversity_penalty(spark, pool):
    """With a cap that makes every branch invalid, rows are only resampled: no penalty may pile up on them."""
    for islands in (0, 3):
        run = anneal.anneal(pool, proposals.MotifScorer("GA"), anneal.with_preset("toy", max_steps=3, branches=2, step_cap=0, diversity=0.5, islands=islands, seed=2))
        assert all(r["fitness"] == _gata([r["seq"]])[0] for r in run.population.collect())


def test_largest_step_by_bins_equals_a_plain_search(spark):
    rng = np.random.default_rng(9)
    for f, lw, most in ((rng.normal(size=400), np.zeros(400), 50.0), (np.r_[rng.normal(size=300), 40.0], np.zeros(301), 2000.0), (rng.exponential(size=200) * 1e-3, rng.normal(size=200) * 0.3, 1e5)):
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(f, lw, strict=True))], "pid long, f double, lw double")
        got = resample.largest_step(df, "f", most, 0.5, "lw")

        def effective(d, f=f, lw=lw):
            w = np.exp(lw - lw.max() + d * (f - f.max()))
            return w.sum() ** 2 / (w * w).sum()

        assert effective(got) >= 0.5 * len(f) * (1 - 1e-9) and (got == most or effective(got * (1 + 1e-6)) < 0.5 * len(f))
    flat = spark.range(5).select("id", F.lit(2.0).alias("f"))
    assert resample.largest_step(flat, "f", 7.0, 0.9) == 7.0


def test_mean_distance_and_fresh_rows(spark, pool):
    rows = {r["pid"]: r["seq"] for r in pool.collect()}
    want = {i: np.mean([sum(a != b for a, b in zip(s, t, strict=True)) for t in rows.values()]) for i, s in rows.items()}
    assert {r["pid"]: r["mean_distance"] for r in profiles.mean_distance(pool).collect()} == pytest.approx(want)
    far = sorted(rows, key=lambda i: (-want[i], i))[:5]
    assert {r["slot"]: r["seq"] for r in resample.diverse_source(pool, 5).collect()} == {k: rows[i] for k, i in enumerate(far)}
    drawn = resample.pool_source(pool, 9, "pid", 3).collect()
    assert sorted(r["slot"] for r in drawn) == list(range(9)) and all(r["seq"] in rows.values() for r in drawn)
    for source in ("diverse", "pool"):
        config = anneal.with_preset("toy", max_steps=2, branches=2, rejuvenate_share=0.2, rejuvenate_from=source, rejuvenate_noise=0.3, seed=3)
        run = anneal.anneal(pool, proposals.MotifScorer("GA"), config, pool=pool)
        assert run.population.count() == len(rows) and all(r["fitness"] == _gata([r["seq"]])[0] for r in run.population.collect())
    with pytest.raises(ValueError):
        anneal.anneal(pool, proposals.MotifScorer("GA"), anneal.with_preset("toy", max_steps=2, rejuvenate_share=0.2, rejuvenate_from="pool"))


def test_anneal_with_a_fitness_for_each_island_and_guided_weights(spark, pool):
    from helixframe.operators.markov import MarkovModel, MarkovProposal
    from helixframe.operators.mutagenesis import WindowScorer

    model, ga = MarkovModel.of(pool, 1), WindowScorer.of_motifs({"GA": 1})
    guide = lambda rate, seed: MarkovProposal(model, rate, seed, "guided", scorer=ga, budget=0.5)
    config = anneal.with_preset("toy", max_steps=2, branches=2, islands=2, branch_correction=True, seed=5)
    run = anneal.anneal(pool, proposals.MotifScorer("GA"), config, ["score", -F.col("score")], guide)
    half = pool.count() // 2
    assert all(r["fitness"] == (1 if r["pid"] < half else -1) * _gata([r["seq"]])[0] for r in run.population.collect())
    assert run.population.where("log_p <> 0").count() > 0
    with pytest.raises(ValueError):
        anneal.anneal(pool, proposals.MotifScorer("GA"), config, ["score"])
