import numpy as np
import pytest

from beatframe.functions import kernels as K


def spec(x, p):
    """Walk outwards sample by sample."""
    lo = [p]
    while lo[-1] >= 0 and x[lo[-1]] <= x[p]:
        lo.append(lo[-1] - 1)
    hi = [p]
    while hi[-1] < len(x) and x[hi[-1]] <= x[p]:
        hi.append(hi[-1] + 1)
    prom = x[p] - max(min(x[i] for i in lo[:-1]), min(x[i] for i in hi[:-1]))
    h = x[p] - prom / 2
    a = next((i for i in range(p, -1, -1) if x[i] <= h), 0)
    b = next((i for i in range(p, len(x)) if x[i] <= h), len(x) - 1)
    left = a + ((h - x[a]) / (x[a + 1] - x[a]) if x[a] < h else 0)
    right = b - ((h - x[b]) / (x[b - 1] - x[b]) if x[b] < h else 0)
    return prom, right - left


@pytest.mark.parametrize("seed", range(40))
def test_prominence_and_width(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=int(rng.integers(3, 150)))
    if seed % 2:
        x = x.round(int(seed % 3))
    pos = K.local_maxima(x)
    prom = K.prominences(x, pos)
    width = K.half_widths(x, pos, prom)
    for p, a, b in zip(pos, prom, width):
        e = spec(x, p)
        assert a == pytest.approx(e[0]) and b == pytest.approx(e[1])


def test_plateaus():
    assert K.local_maxima(np.array([0, 1, 1, 0.0])).tolist() == [1]
    assert K.local_maxima(np.array([0, 1, 1, 1, 0.0])).tolist() == [2]
    assert K.local_maxima(np.array([0, 1, 1, 1, 1, 0.0])).tolist() == [2]
    assert K.local_maxima(np.array([1, 1, 0, 2, 2.0])).tolist() == []


def test_distance_prefers_high_then_late():
    pos, amp = np.array([1, 3, 5, 9]), np.array([1.0, 2.0, 2.0, 0.5])
    every = np.full(4, -1, np.int8), np.ones(4, bool)
    assert K.thin(pos, amp, 3, *every).tolist() == [1, 0, 1, 1]
    assert (K.thin(pos, amp, 1, *every) == 1).all()


def test_sliding_rank_and_lags():
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    assert np.allclose(K.sliding_rank(x, 7, 1), [sorted(x[i:i + 7])[1] for i in range(54)])
    want = [sum(x[i] * x[i + k] for i in range(60 - k)) for k in range(20)]
    assert np.allclose(K.lag_products(x, 60, 19), want)
    halves = K.lag_products(x[:30 + 19], 30, 19) + K.lag_products(x[30:], 30, 19)
    assert np.allclose(halves, want)


def test_trend_window_rules():
    assert K.trend_window(2500, 250.0, 6.0) == 1501
    assert K.trend_window(100, 250.0, 6.0) == 75
    assert K.trend_window(35, 1.0, 6.0) == 31


def test_dominant_lags_of_many_segments_at_once():
    r = np.random.default_rng(3)
    parts = [r.normal(size=n) for n in (40, 3, 90, 2, 61)] + [np.zeros(20)]
    want = [K.dominant_lag(p, 0, len(p) - 1) for p in parts]
    assert K.dominant_many(parts) == want and want[-1] == (-1, 0.0)
