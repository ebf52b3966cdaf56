"""Fitness, penalties and composite scores, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import sequence as S

REJECTED = -1e6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _all(cols) -> list[Column]:
    return [_c(x) for x in cols]


def _largest(cols) -> Column:
    cols = _all(cols)
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def _mean(cols) -> Column:
    cols = _all(cols)
    return reduce(lambda a, b: a + b, cols) / len(cols)


def linear(target, off, weight: float = 1.0, weights: list[float] | None = None) -> Column:
    """t - w mean(off), or t - sum of w_i off_i."""
    if weights:
        return _c(target) - reduce(lambda a, b: a + b, [w * o for w, o in zip(weights, _all(off), strict=True)])
    return _c(target) - weight * _mean(off)


def ratio(target, off) -> Column:
    return _c(target) / (1.0 + F.greatest(F.lit(0.0), _largest(off)))


def log_ratio(target, off, weight: float = 1.0) -> Column:
    zero = F.lit(0.0)
    return F.log1p(F.greatest(zero, _c(target))) - weight * F.log1p(F.greatest(zero, _largest(off)))


def indicator(target, off, threshold: float) -> Column:
    return F.when(_largest(off) < threshold, _c(target)).otherwise(F.lit(REJECTED))


def guidance(mode: str, target, off, weight: float = 1.0, threshold: float = 1.0) -> Column:
    """Reward forms that guide proposals; ``neg_offtarget`` and ``sum_individual`` have no fitness twin."""
    if mode == "neg_offtarget":
        return -_mean(off)
    if mode == "sum_individual":
        return reduce(lambda a, b: a + b, [_c(target) - o for o in _all(off)])
    return {"linear": lambda: linear(target, off, weight), "ratio": lambda: ratio(target, off), "log_ratio": lambda: log_ratio(target, off, weight), "indicator": lambda: indicator(target, off, threshold)}[mode]()


def margin(target, off) -> Column:
    return _c(target) - _largest(off)


def gc_band_penalty(gc, low: float, high: float, weight: float) -> Column:
    zero = F.lit(0.0)
    return -weight * (F.greatest(zero, _c(gc) - high) + F.greatest(zero, low - _c(gc)))


def gc_centre_penalty(gc, middle: float, weight: float) -> Column:
    return -weight * F.abs(_c(gc) - middle)


def edit_discount(fitness, edits, length: int, mode: str = "linear", strength: float = 1.0) -> Column:
    if mode == "linear":
        return _c(fitness) * (1.0 - _c(edits) / F.lit(float(length)))
    return _c(fitness) - strength * F.log1p(_c(edits).cast("double"))


def efficiency(score, edits) -> Column:
    return _c(score) / (1.0 + _c(edits))


def normalised(x, low, high) -> Column:
    return (_c(x) - _c(low)) / F.nullif(_c(high) - _c(low), F.lit(0.0))


def rl_score(target, off1, off2, cut1: float, cut2: float) -> Column:
    return 2.0 * _c(target) - (_c(off1) - cut1) - (_c(off2) - cut2)


def rl_reward(target, off1, off2) -> Column:
    return _c(target) - 0.5 * (_c(off1) + _c(off2))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _bell(x: Column, middle: float, width: float) -> Column:
    z = (x - middle) / width
    return F.exp(-0.5 * z * z)


def plausibility(seq, kmer_z: Column | None = None, cpg_ref: float = 0.036, weights: tuple[float, ...] = (1, 1, 1, 1, 1, 1)) -> Column:
    """Weighted mean of six components in [0, 1]; the k-mer one is 0.5 without a reference profile."""
    runs = S.homopolymer(seq)
    run_part = F.when(runs <= 6, 1.0).when(runs <= 12, 1.0 - (runs - 6) / 12.0).otherwise(0.0)
    parts = [
        _bell(S.gc(seq), 0.52, 0.08),
        _sigmoid(20.0 * (S.entropy(seq) - 1.9)),
        _bell(S.cpg(seq), cpg_ref, 0.03),
        (_bell(S.asymmetry(seq, "A", "T"), 0.0, 0.10) + _bell(S.asymmetry(seq, "G", "C"), 0.0, 0.10)) / 2.0,
        run_part,
        F.lit(0.5) if kmer_z is None else _sigmoid(kmer_z),
    ]
    return reduce(lambda a, b: a + b, [w * p for w, p in zip(weights, parts, strict=True)]) / float(sum(weights))
