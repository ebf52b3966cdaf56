"""Fronts over a grid of blocks against a patience sort in one list, and crowding against plain neighbours."""

import bisect

import numpy as np
import pytest

from helixframe.operators import ranking


def _fronts(pairs):
    ends, out = [], {}
    for s, e in sorted(set(pairs), key=lambda p: (-p[0], p[1])):
        at = bisect.bisect_right(ends, e)
        ends[at : at + 1] = [e]
        out[s, e] = at
    return out


@pytest.mark.parametrize("kind", ["scattered", "few edits", "one front", "one chain"])
def test_fronts_over_blocks(spark, kind):
    rng = np.random.default_rng(5)
    n = 900
    s = rng.integers(0, 400, n)
    e = {"scattered": rng.integers(0, 300, n), "few edits": rng.integers(0, 4, n), "one front": s, "one chain": -s}[kind]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(s, e, strict=True))] + [(9999, None, 1.0)], "pid long, score double, edits double")
    want = _fronts(list(zip(s.tolist(), e.tolist(), strict=True)))
    for size in (150, 10_000):
        got = {r["pid"]: r["front"] for r in ranking.pareto_fronts(df, "pid", "score", "edits", size).collect()}
        assert got == {i: want[a, b] for i, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True))}
    assert ranking.pareto_fronts(df.limit(0), "pid", "score", "edits").count() == 0


def test_crowding_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 50)), float(rng.integers(0, 9)), int(f)) for i, f in enumerate([0] * 60 + [1] * 2 + [2] * 5 + [3])]
    df = spark.createDataFrame(rows, "pid long, score double, edits double, front long")
    want = {}
    for f in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == f]
        total = dict.fromkeys((r[0] for r in mine), 0.0)
        for c in (1, 2):
            order = sorted(mine, key=lambda r: (r[c], r[0]))
            span = order[-1][c] - order[0][c]
            for k, r in enumerate(order):
                total[r[0]] += float("inf") if len(mine) <= 2 or k in (0, len(order) - 1) else (order[k + 1][c] - order[k - 1][c]) / span if span else 0.0
        want |= total
    got = {r["pid"]: r["crowding"] for r in ranking.crowding(df, "score", "edits", "pid").collect()}
    assert got == pytest.approx(want)
