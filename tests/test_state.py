"""States, rolling values, trajectory features and local exponents: against plain Python on small tables, and at the edges."""

import math

import numpy as np
import pytest

from tessella.functions import kernels as k
from tessella.functions import series as s
from tessella.operators import axes, field, rolling, state

R = np.random.default_rng(7)
NAN = float("nan")


def obs(spark, rows):
    return spark.createDataFrame(rows, "cohort string, signal_id string, signal_0 double, value double")


def wave(spark, cohorts="c", signals="ab", n=60, noise=0.1):
    r = np.random.default_rng(1)
    return obs(spark, [(c, x, float(i), float(math.sin(i * (j + 1) / 5) + noise * r.normal())) for c in cohorts for j, x in enumerate(signals) for i in range(n)])


def test_breaks_follow_the_definition():
    y = np.r_[R.normal(0, 1, 150), R.normal(9, 1, 150)]
    y[60] += 30
    floor = [1.4826 * np.median(np.abs(w - np.median(w))) for i in range(300) for w in [y[max(0, i - 25) : i + 25]]]
    assert s.noise_floor(y).tolist() == pytest.approx(floor)
    got = {b["index"]: b for b in s.breaks(y)}
    spike = got[60]
    pre, post = np.median(y[10:60]), np.median(y[61:110])
    assert spike["kind"] == "impulse" and spike["duration"] == 1 and spike["magnitude"] == pytest.approx((y[60] - (pre + post) / 2) / floor[60])
    step = next(b for i, b in got.items() if abs(i - 150) <= 12 and b["kind"] == "step")
    assert step["direction"] == 1 and step["snr"] == pytest.approx((step["post_level"] - step["pre_level"]) / floor[step["index"]]) and step["sharpness"] == pytest.approx(step["snr"] / step["duration"])
    assert all(b - a >= 10 for a, b in zip(sorted(got), sorted(got)[1:]))
    assert s.breaks(np.full(300, NAN)) == []


def test_stability_kernels():
    x = R.normal(size=(3, 40)).cumsum(1)
    got, w = k.hilbert_stability(x), k.wavelet_stability(x)
    for i, y in enumerate(x):
        spectrum = np.fft.fft(y)
        spectrum[1:20] *= 2
        spectrum[21:] = 0
        a = np.fft.ifft(spectrum)
        f = np.diff(np.unwrap(np.angle(a))) / (2 * np.pi)
        assert got["inst_freq_stability"][i] == pytest.approx(min(1, max(0, 1 - f.std() / abs(f.mean())))) and got["phase_coherence"][i] == pytest.approx(np.cos(2 * np.pi * f).mean())
        assert got["am_fm_ratio"][i] == pytest.approx(np.abs(a).std() / f.std()) and got["inst_freq_drift"][i] == pytest.approx(np.polyfit(range(39), f, 1)[0])
        p = np.abs(np.fft.rfft(y)) ** 2
        parts = np.array([p[:7].sum(), p[7:14].sum(), p[14:].sum()])
        runs = np.array([(y[j : j + 4] ** 2).sum() for j in range(37)])
        assert w["wavelet_energy_low"][i] == pytest.approx(parts[0] / parts.sum()) and w["wavelet_energy_ratio"][i] == pytest.approx(parts[0] / parts[2]) and w["wavelet_dominant_scale"][i] == parts.argmax()
        assert w["wavelet_temporal_std"][i] == pytest.approx(runs.std()) and w["wavelet_intermittency"][i] == pytest.approx((((runs - runs.mean()) / runs.std()) ** 4).mean() - 3)
    zero = k.wavelet_stability(np.zeros((1, 20)))
    assert all(math.isnan(v[0]) for v in zero.values())
    assert k.harmonic_ratio(np.sin(2 * np.pi * np.arange(64) / 8)) > 1e6 and math.isnan(k.harmonic_ratio([1.0, 2.0]))


def test_numbers_by_buckets(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tessella.sources import tables

    rows = [("a", None if i % 7 == 0 else i % 3, i * 37 % 50, i) for i in range(50)] + [(None, 1, 1, 99), ("b", None, 0, 100)]
    df = spark.createDataFrame(rows, "g string, day int, t int, id int")
    got = {r.id: r.n for r in tables.numbered(df, ["g"], "day", ["t", "id"]).collect()}
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("day", "t", "id"))).collect()}
    assert got == want and len(got) == 52 and tables.numbered(df.limit(0), ["g"], "day", ["t"]).count() == 0


def test_gaps(spark):
    rows = [("c", "a", 0.0, None), ("c", "a", 1.0, 2.0), ("c", "a", 1.0, 5.0), ("c", "b", 2.0, 7.0), ("c", "a", 10.0, 8.0), ("c", "a", 11.0, NAN), ("c", "none", 0.0, None), ("d", "a", 0.0, 1.0)]
    got = {(r.cohort, r.signal_id, r.signal_0): r.value for r in state.gridded(obs(spark, rows)).collect()}
    assert [got["c", "a", t] for t in (0, 1, 2, 10, 11)] == [2, 2, 5, 8, 8] and len(got) == 16
    assert all(got["c", "b", t] == 7 for t in (0, 1, 2, 10, 11)) and got["c", "none", 2.0] is None
    assert state.gridded(obs(spark, [])).count() == 0


def test_signal_stability(spark):
    df = wave(spark, signals="abc", n=64)
    got = {r.signal_0_end: r for r in state.signal_stability(df, 30, 5).collect()}
    assert sorted(got) == [float(e) for e in range(29, 64, 5)]
    x = {n: np.array([r.value for r in df.where(f"signal_id = '{n}'").orderBy("signal_0").collect()]) for n in "abc"}
    one, h = got[34.0], k.hilbert_stability(np.array([v[5:35] for v in x.values()]))
    assert one.n_signals == one.n_hilbert_signals == 3 and one.signal_0_start == 5
    assert one.h_freq_stability_min == pytest.approx(h["inst_freq_stability"].min()) and one.h_freq_drift_spread == pytest.approx(h["inst_freq_drift"].std())
    short = state.signal_stability(df.where("signal_0 < 6")).collect()
    assert len(short) == 1 and short[0].n_hilbert_signals == 3 and short[0].n_wavelet_signals == 0 and short[0].w_entropy_mean is None
    assert state.signal_stability(df.limit(0)).count() == 0


def test_sensor_eigen(spark):
    df = wave(spark, signals="abc", n=64)
    got = sorted(state.sensor_eigen(df, 20, 4, 6).collect(), key=lambda r: r.signal_0_end)
    x = np.column_stack([[r.value for r in df.where(f"signal_id = '{n}'").orderBy("signal_0").collect()] for n in "abc"])
    means = np.array([x[i : i + 20].mean(0) for i in range(0, 45, 4)])
    assert len(got) == len(means) and got[0].effective_dim is None and got[0].n_signals == 3
    m = means[-6:]
    val = np.sort(np.linalg.eigvalsh(np.corrcoef(m.T) * 6 / 5))[::-1]
    assert [got[-1].eigenvalue_0, got[-1].eigenvalue_1, got[-1].eigenvalue_2] == pytest.approx(val.tolist()) and got[-1].effective_dim == pytest.approx(val.sum() ** 2 / (val**2).sum()) and got[-1].n_samples == 6
    assert state.sensor_eigen(df.where("signal_id = 'a'")).count() == 0 and state.sensor_eigen(df.limit(0)).count() == 0


def test_segments_and_baselines(spark):
    df = wave(spark, "cd", "abc", 100)
    got = {r.cohort: r for r in state.segment_comparison(df).collect()}
    x = np.column_stack([[r.value for r in df.where(f"cohort = 'c' and signal_id = '{n}'").orderBy("signal_0").collect()] for n in "abc"])
    a, b = (np.sort(np.linalg.eigvalsh(np.corrcoef(m.T) * len(m) / (len(m) - 1)))[::-1] for m in (x[:20], x[20:]))
    assert got["c"].n_samples_a == 20 and got["c"].eigenvalue_1_delta == pytest.approx(b[0] - a[0]) and got["c"].condition_number_b == pytest.approx(b[0] / b[2]) and got["c"].segment_b == "post"
    three = state.segment_comparison(df, [("p", 0, 30), ("q", 31, 33), ("r", 34, None)]).collect()
    assert {(r.segment_a, r.segment_b) for r in three} == {("p", "r")}  # q has too few rows
    own = state.baseline_spectrum(df, fleet=False).where("cohort = 'c'").orderBy("signal_id").collect()
    z = (x[:20] - x[:20].mean(0)) / x[:20].std(0)
    u = np.linalg.svd(z, full_matrices=False)
    assert own[0].eigenvalues == pytest.approx((u[1] ** 2 / 19).tolist()) and abs(np.array([r.directions[0] for r in own]) @ u[2][0]) == pytest.approx(1) and own[0].directions[0] > 0
    scores = state.baseline_scores(df, state.baseline_spectrum(df, fleet=False), fleet=False).where("cohort = 'c'").orderBy("signal_0").collect()
    t = (x - x[:20].mean(0)) / x[:20].std(0)
    assert [r.centroid_distance for r in scores] == pytest.approx(np.linalg.norm(t, axis=1).tolist()) and [r.mahalanobis_approx for r in scores] == pytest.approx(np.sqrt(((t @ u[2].T) ** 2 / (u[1] ** 2 / 19)).sum(1)).tolist()) and scores[3].sensor_norm == pytest.approx(np.linalg.norm(x[3]))
    assert state.baseline_spectrum(df.limit(0)).count() == 0 and state.segment_comparison(df.limit(0)).count() == 0


def test_directions_are_continuous():
    v = np.linalg.qr(R.normal(size=(3, 3)))[0]
    got = state.continuous([v, -v, None, -v, v[:, :2]])
    assert np.allclose(got[1], v) and got[2] is None and np.allclose(got[3], -v) and got[4].shape == (3, 2)


def windows(spark, rows):
    return spark.createDataFrame(rows, "cohort string, signal_id string, signal_0_end double, signal_0_center double, x double, y double")


def test_views_and_weights(spark):
    rows = [("c", n, 10.0 * i + 10, 10.0 * i + 5, float(math.sin(i * g)), float(i)) for n, g in (("p", 0.5), ("q", 0.9)) for i in range(40)] + [("c", "late", 400.0, 398.0, 1.0, None)]
    df = windows(spark, rows)
    seen = {r.signal_0_end: {one.signal_id: [x.y for x in one.xs] for one in r.xs} for r in state.histories(df, ["x", "y"], 5).collect()}
    assert seen[30.0] == {"p": [0, 1, 2], "q": [0, 1, 2]} and seen[400.0]["p"] == [35, 36, 37, 38, 39] and seen[400.0]["late"] == [None]
    got = {r.signal_0_end: r for r in state.trajectory_views(df, ["x", "y"]).collect()}
    assert math.isnan(got[20.0].envelope_x_mean or NAN) and got[400.0].laplacian_n_components >= 1
    p, q = (np.sin(np.arange(8, 40) * g) for g in (0.5, 0.9))
    assert got[400.0].fourier_x_dominant_freq == pytest.approx(np.median([k.spectral(v[None])["dominant_freq"][0] for v in (p, q)]))
    w = windows(spark, [("c", "a", 1.0, 1.0, 0.0, 1.0), ("c", "b", 1.0, 1.0, 4.0, 3.0), ("c", "n", 1.0, 1.0, None, 9.0), ("c", "a", 2.0, 2.0, 1.0, 1.0)])
    one, alone = state.weighted_centroid(w, ["x"], "y").orderBy("signal_0_end").collect()
    assert (one.n_signals, one.state_x, one.mean_distance, one.max_distance) == (2, 3, 2, 3) and alone.n_signals == 0 and alone.state_x is None
    both = state.state_vector(df, {"g": ["x", "y"]}).where("signal_0_end = 400").collect()
    assert len(both) == 1 and both[0].state_g_y == pytest.approx(39) and both[0].n_signals == 3


def test_views_of_many_rows_stay_arrays():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(2)
    one = lambda n, gaps=0: [{"x": None if i < gaps else float(v), "y": float(v * v)} for i, v in enumerate(r.normal(size=n))]
    lengths = [[32, 32, 32], [32, 9, 5], [3, 1], [12], [], [32, 32]]
    rows = [[{"signal_id": f"s{i}", "xs": one(n, i)} for i, n in enumerate(ls)] for ls in lengths]
    rows[-1][0]["xs"] = [{"x": 2.0, "y": NAN}] * 32
    kind = pa.list_(pa.struct([("signal_id", pa.string()), ("xs", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
    got = np.column_stack(state._row_views(pa.array(rows, kind), ["x", "y"]))
    middle = lambda v: np.median(v) if len(v) else NAN
    for row, seen in zip(rows, got):
        paths = {f: [np.array([p[f] for p in q["xs"] if p[f] is not None and p[f] == p[f]]) for q in row] for f in ("x", "y")}
        for j, f in ((0, "x"), (8, "y")):
            long, some = ([p for p in paths[f] if len(p) >= n] for n in (8, 4))
            assert seen[j] == pytest.approx(middle([k.spectral(p[None])["dominant_freq"][0] for p in long]), nan_ok=True)
            assert seen[j + 2] == pytest.approx(middle([np.abs(k.analytic(p[None])).mean() for p in some]), nan_ok=True)
            scale = [0.0 if p.std() < 1e-10 else k.wavelet_stability(p[None])["wavelet_dominant_scale"][0] if len(p) >= 10 else NAN for p in long]
            assert seen[j + 5] == pytest.approx(middle([v for v in scale if v == v]), nan_ok=True)
        whole = [np.concatenate(p) for p in zip(paths["x"], paths["y"]) if len(np.concatenate(p))]
        if len(whole) < 2:
            assert np.isnan(seen[16:]).all()
        else:
            m = np.array([np.pad(p, (0, max(map(len, whole)) - len(p))) for p in whole])
            c = np.abs(np.nan_to_num(np.corrcoef(m)))
            np.fill_diagonal(c, 0)
            e = np.sort(np.linalg.eigvalsh(s.laplacian(c)))
            assert seen[16] == pytest.approx(e[1], abs=1e-9) and seen[19] == pytest.approx(e[-1], abs=1e-9)
    many = pa.array([rows[0]] * 5000, kind)
    tracemalloc.start()
    for a in range(0, len(many), state.ROWS):
        state._row_views(many.slice(a, state.ROWS), ["x", "y"])
    assert tracemalloc.get_traced_memory()[1] < 100e6  # as objects, 960,000 numbers and their 480,000 names took more
    tracemalloc.stop()


def test_state_vector_builds_the_windows_once(spark):
    df = windows(spark, [("c", n, 10.0 * i + 10, 10.0 * i + 5, float(i), float(i * i)) for n in "pq" for i in range(9)])
    built = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            built.add(len(b))
            yield b

    assert state.state_vector(df.mapInPandas(seen, df.schema), {"g": ["x", "y"]}).count() == 9 and built.value == 18


def test_rolling(spark):
    df = wave(spark, signals="a", n=50)
    got = {r.signal_0: r for r in rolling.rolling(df, "trend", 20, 10).collect()}
    x = np.array([got[float(i)].value for i in range(50)])
    assert [t for t in sorted(got) if got[t].rolling_trend_slope is not None] == [19, 29, 39, 49] and got[29.0].rolling_trend_slope == pytest.approx(np.polyfit(range(20), x[10:30], 1)[0])
    assert all(r.rolling_trend_slope is None for r in rolling.rolling(df.where("signal_0 < 9"), "trend", 20, 10).collect())
    flat = obs(spark, [("c", "a", float(i), 5.0 if i else None) for i in range(8)])
    assert [r.mad_score for r in rolling.rolling_departures(flat, 2).orderBy("signal_0").collect()] == [None] + [0.0] * 7
    y = [1.0, -1.0, 1.0, 1.0, NAN, -2.0, 0.0, 3.0]
    one = rolling.changes(obs(spark, [("c", "a", float(i), v) for i, v in enumerate(y)]), 8, 8).first()
    v = np.array([a for a in y if a == a])
    d = np.diff(v / v.std())
    assert (one.zero_crossings, one.mean_crossings, one.transition_count) == (int((np.diff(np.sign(v)) != 0).sum()), int((np.diff(np.sign(v - v.mean())) != 0).sum()), int((np.diff(v) != 0).sum()))
    assert (one.mean_roc, one.std_roc, one.max_roc) == pytest.approx((d.mean(), d.std(), np.abs(d).max()))
    empty = rolling.changes(obs(spark, [("c", "a", float(i), None) for i in range(8)]), 8, 8).first()
    assert empty.zero_crossings == 0 and empty.transition_count is None and empty.max_roc is None
    steps = np.arange(32.0)
    binned = rolling.changes(obs(spark, [("c", "a", float(i), float(i)) for i in range(32)]), 32, 8).first()
    assert binned.transition_count == int((np.diff(np.digitize(steps, np.linspace(0, 31, 11), right=True)) != 0).sum())
    slope = rolling.trend_of(obs(spark, [("c", "a", float(i), None if i == 1 else 2.0 * i) for i in range(6)] + [("c", "b", float(i), 1.0) for i in range(3)]), "value", "signal_0", ["cohort", "signal_id"])
    assert {r.signal_id: r.value_slope for r in slope.collect()} == {"a": 2.0, "b": None}


def test_rolling_dynamics(spark):
    df = wave(spark, signals="abc", n=260)
    assert {r.signal_0_end for r in rolling.rolling_saddles(df, 120, 40).collect()} == {119.0, 159.0, 199.0, 239.0}
    assert {r.signal_0_end for r in rolling.rolling_lyapunov(df, 240, 20).collect()} <= {239.0, 259.0} and rolling.rolling_lyapunov(df, 100, 20).count() == 0
    by = rolling.rolling_sensitivity(df, 100, 80).groupBy("signal_0_end").agg({"is_dominant": "count"}).collect()
    assert {r.signal_0_end for r in by} == {99.0, 179.0, 259.0}
    assert rolling.rolling_sensitivity(df, 100, 80).where("is_dominant").count() == 3


def test_typology(spark):
    t = spark.createDataFrame([("a", "CONSTANT", None, False), ("b", "X", "CONSTANT", True), ("c", "X", None, False)], "signal_id string, temporal_primary string, continuity string, is_constant boolean")
    assert {r.signal_id for r in rolling.constant_by_typology(t).collect()} == {"a", "b"} and {r.signal_id for r in rolling.constant_by_typology(t.drop("temporal_primary")).collect()} == {"b"}
    assert rolling.constant_by_typology(t.select("signal_id")).count() == 0
    df = wave(spark, signals="abd", n=3)
    assert {r.signal_id for r in rolling.active(df, t).collect()} == {"a"} and {r.signal_id for r in rolling.active(df, t.select("signal_id")).collect()} == {"a", "b"}
    assert [r.signal_id for r in rolling.unlisted(df, t).collect()] == ["d"]


def signature(spark, rows):
    return spark.createDataFrame(rows, "cohort string, signal_0_end double, arc_length double, effective_dim double, condition_number double, speed double, curvature double")


def test_axis_features(spark):
    n = 11
    arc = np.cumsum(R.random(n))
    dim, cond, speed, curve = R.random((4, n)) * 9
    dim[3] = curve[5] = NAN
    rows = [("a", float(i), float(arc[i]), float(dim[i]), float(cond[i]), float(speed[i]), float(curve[i])) for i in range(n)] + [("short", 0.0, 0.0, 2.0, 1.0, 1.0, None)]
    got = {r.cohort: r.asDict() for r in axes.axis_features(signature(spark, rows), "t").collect()}
    a, pos = got["a"], arc / arc[-1]
    ok = ~np.isnan(dim)
    assert a["t_effective_dim_early"] == pytest.approx(np.nanmean(dim[:3])) and a["t_effective_dim_delta"] == pytest.approx(np.nanmean(dim[-3:]) - np.nanmean(dim[:3])) and a["t_effective_dim_std"] == pytest.approx(np.nanstd(dim))
    assert a["t_effective_dim_slope"] == pytest.approx(np.polyfit(np.arange(n)[ok], dim[ok], 1)[0])
    assert [a[f"t_effective_dim_q{q}"] for q in (1, 2, 3)] == pytest.approx(np.interp([0.25, 0.5, 0.75], pos[ok], dim[ok]).tolist())
    w = pos**2
    assert a["t_speed_pos_weighted"] == pytest.approx((speed * w).sum() / w[~np.isnan(curve)].sum()) and a["t_eff_dim_pos_weighted"] == pytest.approx(np.nansum(dim * w) / w[~np.isnan(curve)].sum())
    assert a["t_curvature_speed_product_late"] == pytest.approx(np.nanmean((curve * speed)[-3:])) and a["t_cond_spike_ratio"] == pytest.approx(cond.max() / cond[:3].mean())
    assert got["short"]["t_n_windows"] == 1 and got["short"]["t_effective_dim_std"] == 0 and got["short"]["t_effective_dim_q1"] is None and got["short"]["t_cond_spike_ratio"] is None and got["short"]["t_curvature_mean"] is None
    match = spark.createDataFrame([("a", 3, 0.5)], "cohort string, trajectory_id int, match_distance double")
    both = {r.cohort: r for r in axes.with_match(axes.axis_features(signature(spark, rows), "t"), match, "t").collect()}
    assert both["a"].t_trajectory_id == 3 and both["short"].t_trajectory_id is None
    assert axes.axis_features(signature(spark, []), "t").count() == 0


def test_subwindows_and_axes(spark):
    n = 7
    dim, cond = R.random((n, 3)) * 3, 10 ** (R.random((n, 3)) * 3)
    geo = spark.createDataFrame([("a", float(i), e, float(dim[i, j]), float(cond[i, j])) for i in range(n) for j, e in enumerate("xyz")], "cohort string, signal_0_end double, engine string, effective_dim double, condition_number double")
    r = axes.subwindow_features(geo, "t").first().asDict()
    assert r["t_sw_eff_dim_spread_max"] == pytest.approx(np.ptp(dim, axis=1).max()) and r["t_sw_n_degenerate"] == int((cond > 100).sum()) and r["t_sw_frac_degenerate"] == pytest.approx((cond > 100).mean())
    assert r["t_sw_cond_max_delta"] == pytest.approx(cond.max(1)[-2:].mean() - cond.max(1)[:2].mean()) and r["t_sw_eff_dim_min_slope"] == pytest.approx(np.polyfit(range(n), dim.min(1), 1)[0])

    def axis(name, rows):
        return spark.createDataFrame(rows, f"cohort string, {name}_effective_dim_delta double, {name}_condition_number_late double, {name}_effective_dim_late double, {name}_trajectory_id int")

    got = {r.cohort: r for r in axes.cross_axis_features({"p": axis("p", [("a", -0.5, 4.0, 2.0, 1), ("b", -0.2, None, 1.0, None)]), "q": axis("q", [("a", 0.1, 8.0, 1.0, 1), ("c", NAN, 1.0, 1.0, 2)])}).collect()}
    a = got["a"]
    assert (a.cross_n_axes_collapsing, a.cross_collapse_on_any, a.cross_collapse_on_all, a.cross_trajectory_agreement, a.cross_n_distinct_trajectories) == (1, 1, 0, 1, 1)
    assert (a.cross_dim_delta_spread, a.cross_cond_late_std, a.cross_dim_late_min) == pytest.approx((0.6, 2, 1)) and got["b"].cross_cond_late_mean is None and got["c"].cross_min_dim_delta is None and got["c"].cross_n_axes_collapsing == 0


def test_signatures(spark):
    geo = spark.createDataFrame([("a", float(i), e, 1.0 * i, 2.0) for i in range(3) for e in ("u", "v")] + [("a", 9.0, "v", 1.0, 1.0)], "cohort string, signal_0_end double, engine string, effective_dim double, eigenvalue_1 double")
    dyn = spark.createDataFrame([("a", float(i), "v", NAN) for i in range(3)], "cohort string, signal_0_end double, engine string, velocity double")
    flow = spark.createDataFrame([("a", float(i), 1.0) for i in range(3)], "cohort string, signal_0_end double, speed double")
    got = axes.signatures(geo, dyn, flow).orderBy("signal_0_end").collect()  # no engine shape: v has most rows
    assert [r.arc_length for r in got] == [0, 1, 2] and math.isnan(got[0].effective_dim_velocity)


def test_neighbours_and_grids():
    square = np.array([[0.0, 0], [1, 0.1], [1.1, 1], [0, 1], [0.5, 0.5]])
    assert field.neighbours(square) == [(0, 1), (0, 3), (0, 4), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert field.neighbours(square[:2]) == [(0, 1)] and field.neighbours(square[:1]) == []
    assert field.neighbours(np.arange(5.0)[:, None], 1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    x = R.normal(size=(30, 2))
    tri = field.neighbours(x)
    links = {i: {j for e in tri for j in e if i in e and j != i} for i in range(30)}
    for i in range(30):  # a point's nearest neighbour is always a Delaunay neighbour
        assert int(np.argsort(np.linalg.norm(x - x[i], axis=1))[1]) in links[i]
    g = field.grid(np.zeros(2), np.array([2.0, 0]))
    assert g.shape == (100, 2) and g[:, 0].min() == -1 and g[:, 0].max() == 3 and g[:, 1].max() == pytest.approx(0.6)
    turn = np.array([[3.0, 0], [0, 0.5]])
    cloud = R.normal(size=(12, 2))
    assert field.strain(cloud, cloud @ turn) == pytest.approx(math.log(3)) and field.strain(cloud[:2], cloud[:2]) == 0


def test_local_exponents_take_the_nearest_rows(spark):
    rows = [(f"c{c:02}", float(t), "e", float(c % 4 + 0.1 * R.normal()), float(c // 4 + 0.1 * R.normal())) for c in range(12) for t in range(6)]
    geo = spark.createDataFrame(rows, "cohort string, signal_0_end double, engine string, eigenvalue_1 double, eigenvalue_2 double")
    got = field.ftle_field(geo).collect()
    p = np.array([[r[3], r[4]] for r in rows])
    at = np.array([p[6 * c : 6 * c + 6].mean(0) for c in range(12)])

    def exponent(x):
        near = np.argsort(np.linalg.norm(p - x, axis=1))[:10]
        both = [j for j in near if j % 6 < 5]
        return field.strain(p[both], p[[j + 1 for j in both]])

    pairs = field.neighbours(at)
    assert {(r.centroid_a, r.centroid_b) for r in got} == {(f"c{i:02}", f"c{j:02}") for i, j in pairs}
    one = next(r for r in got if (r.centroid_a, r.centroid_b) == tuple(f"c{i:02}" for i in pairs[0]))
    g = field.grid(at[pairs[0][0]], at[pairs[0][1]])
    f = np.array([exponent(x) for x in g])
    assert one.ridge_strength == pytest.approx(f.max()) and one.ridge_location == pytest.approx(g[f.argmax()].tolist()) and one.corridor_width == pytest.approx((f < 0.3 * f.max()).mean())
    deep = {r.centroid_id: r for r in field.basins(geo).collect()}
    assert len(deep) == 12 and deep["c00"].basin_radius == pytest.approx(np.percentile(np.linalg.norm(p - at[0], axis=1), 25)) and deep["c00"].n_corridors == sum(0 in e for e in pairs)
    assert field.ftle_field(geo.where("cohort < 'c05'")).count() == 0 and field.basins(geo.limit(0)).count() == 0
