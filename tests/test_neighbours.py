"""Exact near neighbours against all pairs, with groups far larger than what a task compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import neighbours, relational


def _near(rows, t):
    return {i: s is not None and any(j != i and u is not None and len(u) == len(s) and sum(a != b for a, b in zip(s, u, strict=True)) < t for j, u in rows) for i, s in rows}


@pytest.mark.parametrize("kind", ["scattered", "one hot segment", "few places differ"])
def test_near_mask(spark, kind):
    rng = np.random.default_rng(3)
    pick = lambda n: "".join(rng.choice(list("ACGT"), n))
    if kind == "scattered":
        texts = [pick(24) for _ in range(60)]
        texts += ["".join(c if rng.random() > 0.08 else "A" for c in s) for s in texts[:30]]
    elif kind == "one hot segment":
        head = pick(8)
        texts = [head + pick(16) for _ in range(120)] + [head + "A" * 16, head + "A" * 14 + "CC"]
    else:
        base = pick(24)
        texts = [base[:20] + pick(4) for _ in range(150)]
    rows = list(enumerate([*texts, texts[0], None, "", "", "A", "C", None]))
    df = spark.createDataFrame(rows, "pid long, seq string")
    for t, size in ((1, 256), (3, 40), (4, 40), (3, 256)):
        assert {r["pid"]: r["near"] for r in neighbours.near_mask(df, t, group_rows=size).collect()} == _near(rows, t), (t, size)
    assert neighbours.near_mask(df, 0).where("near").isEmpty() and neighbours.near_mask(df.limit(0), 3).count() == 0


def test_distances_to_a_sample_by_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 9, 60)]
    pool = [(i, t) for i, t in enumerate(texts)] + [(3, "ACG"), (60, None), (None, "ACGT")]
    sample = [*pool[:7], (60, None)]
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    want = []
    for key, a in pool:
        every = [(k, far(a, b)) for k, b in sample if a is not None and b is not None]
        want.append((key, a, min((d for k, d in every if k != key), default=None), sum(d for _, d in every) / len(every) if every else None))
    df = spark.createDataFrame(pool, "pid long, seq string")
    few = spark.createDataFrame(sample, "pid long, seq string")
    shown = lambda rows: sorted(map(repr, rows))
    got = [tuple(r) for r in relational.distances_to(df, few).select("pid", "least", F.round("mean", 9)).collect()]
    assert shown(got) == shown((k, m, None if a is None else round(a, 9)) for k, _, m, a in want)
    assert all(r["least"] is None and r["mean"] is None for r in relational.distances_to(df, few.limit(0)).collect())
    assert relational.distances_to(df.limit(0), few).count() == 0
