"""Functions that no query reaches: history files, schedules, finite pairs, the constraint's step, header-less tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import schedule
from helixframe.operators import archives, profiles, relational
from helixframe.sources import sequences, sinks


def test_history_as_json(spark, tmp_path):
    df = spark.createDataFrame([(s, s * 0.5, None if s else 1.0) for s in (3, 0, 2, 1)], "step long, mean double, gain double").repartition(3)
    sinks.write_history(df, str(tmp_path / "h"))
    lines = [json.loads(x) for f in (tmp_path / "h").glob("part-*.json") for x in f.read_text().splitlines()]
    assert lines == [{"step": 0, "mean": 0.0, "gain": 1.0}, *({"step": s, "mean": s * 0.5} for s in (1, 2, 3))]
    sinks.append_history(df, str(tmp_path / "t"))
    assert sinks.resume_step(spark, str(tmp_path / "t")) == 4
    told = archives.history(spark.createDataFrame([(s, i, f"s{i % 3}", float(i + s)) for s in range(5) for i in range(6)], "step long, pid long, seq string, score double"))
    assert [r["mean"] for r in told.orderBy("step").collect()] == pytest.approx([2.5 + s for s in range(5)])


def test_schedules_by_hand():
    assert [schedule.branches("linear_2_10", 4, s, 5) for s in range(5)] == [2, 4, 6, 8, 10]
    assert [schedule.branches("step_1_2_4", 4, s, 9) for s in (0, 3, 8)] == [1, 2, 4]
    assert [schedule.branches("late_1_8", 4, s, 11) for s in (0, 7, 8, 10)] == [1, 1, 8, 8]
    assert [schedule.branches("early_8_1_50", 4, s, 11) for s in (0, 4, 5)] == [8, 8, 1]
    assert [schedule.branches([3, 0, 5], 4, s, 9) for s in (0, 1, 2, 7)] == [3, 1, 5, 5] and schedule.branches(None, 4, 3, 9) == 4
    assert schedule.progress(5.0, 0.0, 10.0) == 0.5 and schedule.progress(5.0, 3.0, 3.0) == 1.0 and schedule.annealed(0.1, 0.3, 0.5) == pytest.approx(0.2)
    with pytest.raises(ValueError, match="unknown schedule"):
        schedule.branches("often_1_2", 4, 0, 9)


def test_finite_pairs_and_the_constraint(spark):
    bad = (None, float("nan"), float("inf"), -float("inf"))
    df = spark.createDataFrame([(1.0, 2.0), *((b, 1.0) for b in bad), *((1.0, b) for b in bad)], "a double, b double")
    assert [tuple(r) for r in relational.finite_pairs(df, "a", "b").collect()] == [(1.0, 2.0)]
    assert profiles.lagrange_step(0.5, 0.62, 0.5, 0.02, 2.0) == pytest.approx(0.7) and profiles.lagrange_step(0.1, 0.5, 0.5, 0.02, 50.0) == 0.0


def test_table_without_a_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ACGT\t0.5\t1\nGGGG\t-2.0\t0\n")
    df = sequences.read_positional_tsv(spark, str(tmp_path / "a.tsv"), ["seq", "score", "rev", "more"])
    assert df.columns == ["seq", "score", "rev"] and sorted(map(tuple, df.collect())) == [("ACGT", 0.5, 1), ("GGGG", -2.0, 0)]


def test_dense_profile_and_sequence_profile(spark):
    df = spark.createDataFrame([(1, "ACGTACG"), (2, "AAAA")], "pid long, seq string")
    got = {(r["pid"], r["kmer"]): r["share"] for r in profiles.sequence_profile(df).collect()}
    assert got == pytest.approx({(1, "ACG"): 0.4, (1, "CGT"): 0.2, (1, "GTA"): 0.2, (1, "TAC"): 0.2, (2, "AAA"): 1.0})
    dense = sequences.dense_profile(profiles.pool_profile(df).select("kmer", F.col("n").cast("double").alias("n")))
    assert dense.count() == 64 and dense.agg(F.sum("n")).first()[0] == 7 and np.isclose(dense.where("kmer = 'ACG'").first()["n"], 2)
