"""Mutagenesis by deltas against all candidates scored one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import mutagenesis, proposals

SCORERS = [mutagenesis.WindowScorer.of_motifs({"GA": 1, "CG": 2, "GATA": 5}), mutagenesis.WindowScorer(((3, tuple((i * 5 + 3) % 17 - 8 for i in range(64))),), 0.5)]


def _score(s, scorer):
    return scorer.scale * sum(t[sum("ACGT".index(b) * 4 ** (k - 1 - j) for j, b in enumerate(s[i : i + k]))] for k, t in scorer.tables for i in range(len(s) - k + 1))


def _best(s, scorer):
    every = [(-_score(s[:p] + b + s[p + 1 :], scorer), p, b) for p in range(len(s)) for b in "ACGT" if b != s[p]]
    v, p, b = min(every)
    return p, b, s[:p] + b + s[p + 1 :], -v


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (30, 30, 30, 7, 3, 2, 1)]
    return [(i, s) for i, s in enumerate([*texts, texts[0], "", None])]


@pytest.mark.parametrize("scorer", SCORERS, ids=["motifs", "trimers"])
def test_best_flip_climb_and_walk(spark, rows, scorer):
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "pid long, seq string, other string")
    want = {i: _best(s, scorer) for i, s in rows if s}
    got = {r["pid"]: (r["position"], r["base"], r["candidate"], r["candidate_score"]) for r in proposals.best_flip(df, scorer).collect()}
    assert got == want
    gaining = {r["pid"] for r in proposals.best_flip(df, scorer, require_gain=True).collect()}
    assert gaining == {i for i, w in want.items() if w[3] > _score(dict(rows)[i], scorer)}
    climbed = {}
    for i, s in rows:
        now = s
        for _ in range(4 if s else 0):
            _, _, then, v = _best(now, scorer)
            if v > _score(now, scorer) and sum(a != b for a, b in zip(then, s, strict=True)) <= 3:
                now = then
        climbed[i] = now
    assert {r["pid"]: r["seq"] for r in proposals.hill_climb(df, scorer, 4, 30, cap=3).collect()} == climbed
    walk = {(r["pid"], r["generation"]): r["seq"] for r in proposals.ism_trajectory(df, scorer, 3).collect()}
    for i, s in rows:
        now = s
        for g in range(4 if s else 1):
            assert walk[i, g] == now
            now = _best(now, scorer)[2] if s else now


def test_foreign_scorers_see_every_candidate(spark, rows):
    df = spark.createDataFrame([(i, s) for i, s in rows if s], "pid long, seq string")
    own = SCORERS[0]
    foreign = lambda s: own(s) + F.lit(0.0)
    key = lambda d: sorted((r["pid"], r["candidate"], r["candidate_score"]) for r in d.collect())
    assert key(proposals.best_flip(df, foreign)) == key(proposals.best_flip(df, own))
    assert sorted(map(tuple, proposals.hill_climb(df, foreign, 2, 30).select("pid", "seq").collect())) == sorted(map(tuple, proposals.hill_climb(df, own, 2, 30).select("pid", "seq").collect()))
    found = proposals.single_substitutions(df)
    assert found.count() == sum(3 * len(s) for _, s in rows if s)
    assert found.where(S.hamming("seq", "candidate") != 1).count() == 0
    assert proposals.best_flip(df.limit(0), own).count() == 0
