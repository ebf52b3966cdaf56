"""Markov proposals against plain samplers and enumerated spaces."""

import hashlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import markov, mutagenesis, proposals

BASES = "ACGT"


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, "".join(rng.choice(list(BASES), 24, p=[0.4, 0.1, 0.2, 0.3]))) for i in range(40)] + [(100, "ACG"), (101, ""), (102, None)], "pid long, seq string")


def _counts(rows, order):
    n = {}
    for s in rows:
        for i in range(len(s or "") - order):
            n[s[i : i + order + 1]] = n.get(s[i : i + order + 1], 0) + 1
    return n


def _follows(n, order, context):
    context = context[-order:] if order else ""
    return [1 + sum(v for k, v in n.items() if k[order - len(context) :] == context + b) for b in BASES]


def _word(key, i):
    return int.from_bytes(hashlib.md5(f"{key}:{i // 4}".encode()).digest()[4 * (i % 4) : 4 * (i % 4) + 4], "big")


def test_left_to_right_equals_a_plain_sampler(spark, pool):
    order, rate, seed = 2, 0.4, 3
    model = markov.MarkovModel.of(pool, order)
    n = _counts([r["seq"] for r in pool.collect()], order)
    got = {(r["pid"], r["k"]): (r["seq"], r["log_p"]) for r in markov.MarkovProposal(model, rate, seed, rounds=2).expand(pool.withColumn("note", F.lit("x")), 2, 7).collect()}
    assert len(got) == 86 and got[102, 0][0] is None
    for r in pool.collect():
        for k in range(2):
            s, log_p = r["seq"], 0.0
            for turn in range(2 if s else 0):
                new = ""
                for i, base in enumerate(s):
                    tail = f"{r['pid']}:{k}:7:{turn}"
                    if _word(f"{seed}:mask:{tail}", i) / 2**32 < rate:
                        c = np.cumsum(_follows(n, order, new))
                        base = BASES[int(((_word(f"{seed}:base:{tail}", i) * int(c[3])) >> 32 >= c[:3]).sum())]
                        log_p += np.log(_follows(n, order, new)[BASES.index(base)] / c[3])
                    new += base
                s = new
            assert got[r["pid"], k][0] == s and got[r["pid"], k][1] == pytest.approx(log_p)


def _chance(model, codes):
    at, p = 0, 1.0
    for c in codes:
        p *= model.p[at, c]
        at = model.next[at, c]
    return p


@pytest.mark.parametrize("order", [0, 1, 2])
def test_two_sided_draws_the_joint_distribution(pool, order):
    model = markov.MarkovModel.of(pool, order)
    mask, now = np.array([1, 0, 1, 1, 0, 0, 1], bool), np.array([0, 1, 2, 3, 0, 2, 1])
    fills = list(product(range(4), repeat=int(mask.sum())))
    weight = []
    for f in fills:
        codes = now.copy()
        codes[mask] = f
        weight.append(_chance(model, codes))
    want = dict(zip(fills, np.array(weight) / sum(weight), strict=True))
    n = 20_000
    d = markov._Draw(np.tile(now, (n, 1)), np.tile(mask, (n, 1)), np.random.default_rng(1).integers(0, 1 << 32, (n, len(now))))
    codes, log_p = markov.two_sided(model, d)
    assert (codes[:, ~mask] == now[~mask]).all()
    seen = {}
    for c, p in zip(codes, log_p, strict=True):
        f = tuple(c[mask])
        seen[f] = seen.get(f, 0) + 1
        assert p == pytest.approx(np.log(want[f]))
    assert max(abs(seen.get(f, 0) / n - p) for f, p in want.items()) < 0.012
    # One place at a time: the same distribution as from all sequences that differ there.
    near = markov.neighbourly(model, now[None])[0]
    for i in range(len(now)):
        alone = [_chance(model, np.r_[now[:i], b, now[i + 1 :]]) for b in range(4)]
        assert near[i] == pytest.approx(np.array(alone) / sum(alone))


def test_guidance_keeps_its_budget_and_its_weights_are_unbiased(spark, pool):
    model, scorer = markov.MarkovModel.of(pool, 1), mutagenesis.WindowScorer.of_motifs({"GA": 1, "CG": 2})
    now, n = np.array([0, 3, 2, 1, 0, 1]), 30_000
    mask = np.array([0, 1, 1, 0, 1, 0], bool)
    base, gain = markov.neighbourly(model, now[None])[0][mask], scorer.gains(now[None])[0][mask].astype(float)
    for budget in (0.0, 0.05, 0.5, 100.0):
        q, strength = markov.tilted(base, gain, np.zeros(3, np.int64), 1, budget)
        kl = (q * np.log(np.maximum(q, 1e-300) / base)).sum()
        assert kl <= budget + 1e-9 and (budget in (0.0, 100.0) or kl == pytest.approx(budget, rel=1e-6)) and strength[0] <= 1e3
    d = markov._Draw(np.tile(now, (n, 1)), np.tile(mask, (n, 1)), np.random.default_rng(2).integers(0, 1 << 32, (n, len(now))))
    codes, _, ratio = markov.guided(model, d, scorer, 0.3)
    plain = sum(np.prod([base[i, f[i]] for i in range(3)]) * scorer.totals(np.array([[0, f[0], f[1], 1, f[2], 1]]))[0] for f in product(range(4), repeat=3))
    w = np.exp(ratio)
    assert w.mean() == pytest.approx(1.0, abs=0.03) and (w * scorer.totals(codes)).mean() == pytest.approx(plain, abs=0.05)
    assert scorer.totals(codes).mean() > plain
    out = markov.MarkovProposal(model, 0.3, 5, "guided", scorer=scorer, budget=0.5).expand(pool, 3, 0)
    best = proposals.prefiltered(out, 1, "log_p")
    assert out.count() == 129 and best.count() == 43 and out.where("log_ratio <> 0").count() > 50
