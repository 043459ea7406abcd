"""Kernels against what is known of their inputs, and window edge cases."""

import math

import numpy as np
import pytest

from tessella.functions import kernels as k
from tessella.functions import series as s
from tessella.functions.engines import ENGINES
from tessella.operators import geometry as G
from tessella.operators import signal_vector as V
from tessella.operators import statistics as S
from tessella.operators import windows as W

R = np.random.default_rng(42)


def test_sine():
    x = np.sin(2 * np.pi * 10 * np.linspace(0, 1, 1000))[None]
    assert 9 <= k.spectral(x)["dominant_freq"][0] * 1000 <= 11
    assert k.moments(x)["crest_factor"][0] == pytest.approx(math.sqrt(2), rel=0.01)
    assert k.rms(x)["rms"][0] == pytest.approx(1 / math.sqrt(2), rel=0.01)


def test_random_walk_hurst():
    assert 0.3 <= k.hurst(R.normal(size=1000).cumsum()[None])["hurst"][0] <= 0.7


@pytest.mark.parametrize("name", sorted(ENGINES))
def test_engine_shapes(name):
    x = R.normal(size=(3, 128)).cumsum(1)
    assert all(v.shape == (3,) for v in ENGINES[name].kernel(x).values())


def test_breaks():
    step = s.breaks(np.r_[np.full(500, 10.0), np.full(500, 20.0)])
    assert len(step) == 1 and abs(step[0]["index"] - 500) <= 20 and step[0]["direction"] == 1 and step[0]["duration"] <= 5
    assert s.breaks(np.r_[np.full(500, 30.0), np.full(500, 10.0)])[0]["direction"] == -1
    assert len(s.breaks(R.normal(size=1000), 0.5)) < 5
    assert len(s.breaks(np.repeat([0.0, 10, 5, 15, 8], 200))) >= 3
    assert s.breaks(np.full(500, 5.0)) == [] and s.breaks(np.array([1.0, 2, 3])) == [] and s.breaks(np.zeros(0)) == []


def test_distributions():
    assert s.f_tail(3.0, 5, 100) == pytest.approx(0.0144926, abs=1e-6)
    assert s.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0
    x = R.normal(size=600)
    assert s.granger(x, np.r_[0, x[:-1]] + 0.1 * R.normal(size=600))[1] < 1e-6
    assert s.copula(x, x + 0.2 * R.normal(size=600))["kendall_tau"] > 0.8


def test_clusters():
    d = np.abs(np.subtract.outer([0, 1, 2, 50, 51], [0, 1, 2, 50, 51])).astype(float)
    assert len(set(s.ward(d, 2)[:3])) == 1 and s.ward(d, 2)[0] != s.ward(d, 2)[4]


def test_eigen_degenerate():
    assert G.eigen(np.ones((4, 3))) is None and G.eigen(np.full((4, 3), np.nan)) is None
    e = G.eigen(R.normal(size=(30, 3)))
    assert 1 <= e["effective_dim"] <= 3 and e["total_variance"] == pytest.approx(3 * 30 / 29, rel=1e-6)


def obs(spark, rows):
    return spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double")


def test_window_edges(spark):
    rows = [("a", "short", float(i), 1.0) for i in range(5)] + [("a", "exact", float(i), float(i)) for i in range(8)] + [("a", "nulls", float(i), None) for i in range(9)]
    df = obs(spark, rows)
    got = {r.signal_id: r for r in W.features(df, 8, 4).collect()}
    assert set(got) == {"exact", "nulls"} and got["exact"].mean == 3.5 and got["nulls"].mean is None
    partial = {r.signal_id: r.values for r in W.arrays(df, 8, 4, partial=True).collect()}
    assert len(partial["short"]) == 5 and partial["exact"] == [float(i) for i in range(8)] and partial["nulls"] == []
    assert W.features(obs(spark, []), 8, 4).count() == 0
    apart = W.features(obs(spark, [("a", "s", float(i), float(i)) for i in range(20)]), 4, 10).orderBy("window_id").collect()
    assert [(r.window_id, r.mean, r.signal_0_end) for r in apart] == [(0, 1.5, 3.0), (1, 11.5, 13.0)]


def test_reach_and_engines(spark):
    df = obs(spark, [("a", "s", float(i), math.sin(i)) for i in range(200)])
    got = W.arrays(df, 32, 32, reach=64).orderBy("window_id").collect()
    assert [len(r.values) for r in got] == [32, 64, 64, 64, 64, 64] and got[1].signal_0_start == 32
    half = W.arrays(df, 64, 32, reach=128).orderBy("window_id").collect()
    assert [len(r.values) for r in half] == [64, 96, 128, 128, 128] and half[2].values[-1] == math.sin(127)
    out = V.signal_vector(df, ["statistics", "spectral", "hurst"], 32, 32)
    assert out.count() == 6 and {"kurtosis", "dominant_freq", "hurst"} <= set(out.columns)


def test_normalize_round_trip(spark):
    df = obs(spark, [("a", "s", float(i), float(i * i)) for i in range(20)] + [("a", "c", float(i), 5.0) for i in range(20)])
    for m in ("zscore", "robust", "mad", "minmax", "none"):
        back = S.denormalize(S.normalize(df, m)).select("signal_id", "signal_0", "value").collect()
        assert all(abs(r.value - (5.0 if r.signal_id == "c" else r.signal_0**2)) < 1e-6 for r in back)


def test_loops_of_a_circle_and_of_all_triangles():
    from itertools import combinations

    from tessella.functions import series

    a = 2 * np.pi * np.arange(60) / 60
    got = series.homology(np.column_stack([np.cos(a), np.sin(a)]))
    assert got["n_loops"] == 1 and abs(got["max_persistence_h1"] - (3**0.5 - 2 * np.sin(np.pi / 60))) < 1e-6
    for seed in range(5):
        x = np.random.default_rng(seed).normal(size=(18, 2))
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        edges = sorted(combinations(range(18), 2), key=lambda e: d[e])
        rank, low, best = {e: k for k, e in enumerate(edges)}, {}, 0.0
        for t in sorted((sorted(rank[s] for s in combinations(c, 2)) for c in combinations(range(18), 3)), key=lambda t: t[2]):
            col = set(t)
            while col and max(col) in low:
                col ^= low[max(col)]
            if col:
                low[max(col)] = col
                best = max(best, d[edges[t[2]]] - d[edges[max(col)]])
        assert abs(series.homology(x)["max_persistence_h1"] - best) < 1e-6


def test_homologies_of_many_windows_at_once(monkeypatch):
    from tessella.functions import series

    r = np.random.default_rng(5)
    many = [r.normal(size=(9, 60, 4)), r.normal(size=(5, 64, 20)), np.round(r.normal(size=(9, 40, 2)) * 2) / 2, np.zeros((2, 12, 3)), r.normal(size=(3, 70, 2))]
    want = [[series.homology(w) for w in windows] for windows in many]
    monkeypatch.setattr(series, "AT_ONCE", 4)
    assert len(series.homologies(many[4])["n_loops"]) == 3  # too many points for a word: one by one
    monkeypatch.setattr(series, "homology", lambda *a: pytest.fail("a window by itself"))
    for windows, each in zip(many[:4], want):
        got = series.homologies(windows)
        for c, x in got.items():
            assert list(x) == pytest.approx([w[c] for w in each], abs=1e-6)
