"""The network's batched products against plain sums."""

import numpy as np

from helixframe.llm import lm_score


def test_sums_by_class():
    rng = np.random.default_rng(1)
    y = np.sort(np.minimum(rng.geometric(0.1, 500), 60))
    rows, places = rng.normal(size=(700, 5)).astype(np.float32), rng.permutation(700)[:500]
    first = np.flatnonzero(np.diff(y, prepend=-1))
    got = lm_score._sums(rows, places, first)
    assert np.allclose(got, np.add.reduceat(rows[places].astype(float), first), atol=1e-5)


def test_a_step_goes_down_the_slope_of_the_mean_loss():
    rng = np.random.default_rng(2)
    classes = np.minimum(rng.geometric(0.02, 300), lm_score.CLASSES - 1).astype(np.uint16)
    y = lm_score.spaced(classes, np.array([100, 200]))
    part, at = next(lm_score.batches_of(y))
    start = lm_score.Network.start()
    net = lm_score.Network(start)
    h, ends = net.hidden(part, at), net.by_cluster(part, at)
    assert np.allclose(net.members(h[ends[0]], ends[3]), np.stack([x @ net.inner[c] for x, c in zip(h[ends[0]], ends[1], strict=True)]), atol=1e-5)
    net.step(part, at, 0.01)
    moved = net.flat - start.astype(np.float32)
    before = lm_score.Network(start).log_probability(part, at).mean()
    gain = net.log_probability(part, at).mean() - before
    assert np.isclose(gain, float(moved @ moved) / 0.01, rtol=0.05)


def test_sums_of_rows_side_by_side():
    rng = np.random.default_rng(3)
    y = np.sort(np.minimum(rng.geometric(0.1, 400), 60))
    rows, places = rng.normal(size=(404, 5)).astype(np.float32), rng.permutation(400)
    beside = places[:, None] + np.array([0, 1, 3, 4])
    first = np.flatnonzero(np.diff(y, prepend=-1))
    want = np.add.reduceat(rows[beside].reshape(400, 20).astype(float), first)
    assert np.allclose(lm_score._sums(rows, beside, first), want, atol=1e-5)


def test_embeddings_of_a_class_lie_side_by_side():
    net = lm_score.Network(lm_score.Network.start())
    assert net.beside.flags.c_contiguous and net.embed.shape == (len(lm_score.SIDES), lm_score.CLASSES, lm_score.WIDTH)
    rng = np.random.default_rng(lm_score.WIDTH)
    y = lm_score.spaced(rng.integers(1, lm_score.CLASSES, 50).astype(np.uint16), np.array([20, 30]))
    at = np.flatnonzero(y)
    want = np.tanh(sum(net.embed[s][y[at + d]].astype(float) for s, d in enumerate(lm_score.SIDES)))
    assert np.allclose(net.hidden(y, at)[:, :-1], want, atol=1e-6)


def test_tanh_of_any_size():
    x = np.array([[-200, -3, -1e-3, 0, 1e-3, 0.5, 3, 200]], np.float32)
    assert np.allclose(lm_score._tanh(x.copy()), np.tanh(x.astype(float)), atol=5e-7)
