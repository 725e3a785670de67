import tracemalloc

import numpy as np
import pytest

from actiscope.llm import gru


def test_every_stretch_of_every_training_text_is_learned_from():
    units, size, whole = gru.stretches(np.arange(25), np.array([10, 0, 15]), 6)
    assert units.tolist() == list(range(25)) and size.sum() == 25 and whole.sum() == 3


def test_lanes_hold_the_cells_of_texts_only():
    """One long text among short ones: memory follows the words, not the longest text times the lanes."""
    lens = np.r_[20_000, np.full(4000, 10)]
    units = np.random.default_rng(0).integers(1, gru.UNITS, lens.sum())
    net = gru.Network()
    gru.likelihood(net, units, lens)
    tracemalloc.start()
    got = gru.likelihood(net, units, lens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(lens) and np.isfinite(got).all()
    assert peak < 400 * lens.sum()


def test_large_logits():
    """Beyond the size up to which exponentials are taken of logits as they are."""
    rng = np.random.default_rng(5)
    net = gru.Network()
    net.w["wi"][...], net.w["bo"][...] = rng.standard_normal(net.w["wi"].shape) * 80, rng.standard_normal(gru.CLASSES) * 200
    states, y = rng.uniform(-1, 1, (gru.HIDDEN, 500)).astype(np.float32), rng.integers(0, gru.UNITS, 500)
    w = {k: v.astype(float) for k, v in net.w.items()}
    want = []
    for s, unit in zip(states.T.astype(float), y.tolist(), strict=True):
        k, i = divmod(unit, gru.WITHIN)
        logits = s @ w["wo"] + w["bo"], s @ w["wi"][k] + w["bi"][k]
        want.append(sum(v[j] - v.max() - np.log(np.exp(v - v.max()).sum()) for v, j in zip(logits, (k, i), strict=True)))
    assert max(np.abs(w["bo"]).max(), np.abs(w["wi"]).max()) > gru.FAR
    assert net.log_probs(states, y) == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_training_goes_on_over_windows_and_stops():
    """Texts of any length, empty ones too: every word counts once, and the loss falls."""
    rng = np.random.default_rng(2)
    lens = np.array([0, 1, 3000, 17, 0, 900])
    units = rng.choice([1, 2, 1500], lens.sum())
    net = gru.Network()
    before = gru.likelihood(net, units, lens).sum()
    parts = gru.stretches(units, lens)[1]
    assert gru.train(net, gru.Adam(net, 0.05), units, lens) == parts.sum() + len(parts)
    assert gru.likelihood(net, units, lens).sum() > before + 1000
