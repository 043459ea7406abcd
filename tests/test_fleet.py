"""Kernels and plans of windows of several signals, pairs and ridges on small tables."""

import math

import numpy as np
import pytest

from tessella.functions import series
from tessella.operators import curves, fleet, geometry, grouped


def test_window_metrics():
    r = np.random.default_rng(42)
    m = r.normal(size=(4, 50))
    got = series.window_metrics(m)
    val = np.sort(np.linalg.eigvalsh(np.cov(m)))[::-1]
    assert list(got) == series.METRICS and len(got) == 18
    assert got["effective_dim"] == pytest.approx(val.sum() ** 2 / (val**2).sum()) and got["ratio_3_1"] == pytest.approx(val[2] / val[0])
    assert got["mean_abs_correlation"] == pytest.approx(np.abs(np.corrcoef(m))[np.triu_indices(4, 1)].mean())
    assert 0 < got["algebraic_connectivity"] <= 4 / 3 + 1e-9
    same = series.window_metrics(np.vstack([m[0], m[0], m[0]]))
    assert same["effective_dim"] == pytest.approx(1) and same["mean_dist_to_centroid"] == pytest.approx(0)
    assert math.isnan(series.window_metrics(m[:1])["effective_dim"]) and math.isnan(series.window_metrics(m * np.nan)["total_variance"])


def test_fingerprint_has_450_features(spark):
    rows = spark.range(200).selectExpr("explode(array('a', 'b')) cohort", "id").selectExpr("cohort", "explode(array('p', 'q', 'r')) signal_id", "cast(id as double) signal_0", "if(cohort = 'a', sin(id * ascii(signal_id)), id * id / 100.0 + sin(id * ascii(signal_id))) value")
    got = {r.cohort: r.asDict() for r in grouped.fingerprint(rows).collect()}
    assert set(got) == {"a", "b"} and all(len(r) == 451 for r in got.values())
    assert got["b"]["mean_abs_correlation_mean"] > got["a"]["mean_abs_correlation_mean"]
    assert grouped.fingerprint(rows.where("signal_0 < 49")).count() == 0


def test_curve_features(spark):
    data = {"a": [3.0, None, 5.0, float("nan"), 9.0, 8.0, 2.0], "short": [1.0, 4.0], "flat": [2.0] * 5, "none": [None, None, None]}
    rows = spark.createDataFrame([(k, float(i), v) for k, x in data.items() for i, v in enumerate(x)], "cohort string, t double, m double")
    got = {r.cohort: r.asDict() for r in curves.curve_features(rows, ["cohort"], "t", ["m"]).collect()}
    assert len(got["a"]) == 26
    a = got["a"]
    assert (a["m_first"], a["m_last"], a["m_delta"], a["m_range"], a["m_early_mean"], a["m_mid_mean"], a["m_late_mean"]) == (3, 2, -1, 7, 3, 5, 5)
    assert a["m_spike_ratio"] == pytest.approx(3) and (a["m_vel_mean"], a["m_vel_min"], a["m_vel_late_mean"], a["m_acc_mean"]) == (-3.5, -6, -6, -5)
    assert a["m_curvature_mean"] == pytest.approx(5 / 37**1.5) and a["m_slope"] == pytest.approx(np.polyfit([0, 2, 4, 5, 6], [3, 5, 9, 8, 2], 1)[0])
    assert got["short"]["m_slope"] is None and got["short"]["m_vel_mean"] is None and got["short"]["m_delta"] == 3
    assert got["flat"]["m_r2"] == 0 and got["flat"]["m_curvature_mean"] == 0 and got["none"]["m_mean"] is None
    assert curves.curve_features(rows.limit(0), ["cohort"], "t", ["m"]).count() == 0


def test_pairs_ask_for_causality_by_loadings(spark):
    w = spark.createDataFrame([("c", 1.0, s, x, y) for s, x, y in (("p", 1.0, 2.0), ("q", 2.0, 4.0), ("r", -3.0, 1.0), ("n", None, 1.0))], "cohort string, signal_0_end double, signal_id string, x double, y double")
    loads = spark.createDataFrame([("c", 1.0, "p", 0.8), ("c", 1.0, "q", -0.7), ("c", 1.0, "r", 0.1)], "cohort string, signal_0_end double, signal_id string, pc1_loading double")
    got = {(r.signal_a, r.signal_b): r for r in fleet.signal_pairwise(w, ["x", "y"], loads).collect()}
    assert set(got) == {("p", "q"), ("p", "r"), ("q", "r")}
    assert got["p", "q"].needs_granger and not got["p", "r"].needs_granger and got["p", "q"].cosine_similarity == pytest.approx(1)
    assert [r.needs_granger for r in fleet.cohort_pairwise(w.select(F("signal_0_end"), F("signal_id").alias("cohort"), "x", "y"), ["x", "y"]).collect()] == [True] * 3


def F(name):
    from pyspark.sql import functions

    return functions.col(name)


def test_ridge_classes(spark):
    rolling = spark.createDataFrame([("c", "s", float(t), f) for t, f in ((0, 0.0), (10, 0.04), (20, 0.08), (30, 0.02), (40, 0.02))], "cohort string, signal_id string, signal_0_end double, ftle double")
    field = spark.createDataFrame([("c", float(t), 2.0) for t in (0, 10, 20, 30, 40)], "cohort string, signal_0_end double, speed double")
    got = {r.signal_0_end: r for r in grouped.ridge_proximity(rolling, field).collect()}
    grad = np.gradient([0.0, 0.04, 0.08, 0.02, 0.02], [0, 10, 20, 30, 40])
    assert [got[t].ftle_gradient for t in sorted(got)] == pytest.approx(grad.tolist())
    assert [got[t].urgency_class for t in sorted(got)] == ["warning", "warning", "elevated", "nominal", "nominal"]
    assert got[10.0].time_to_ridge == pytest.approx(0.01 / (2 * grad[1])) and got[40.0].time_to_ridge == float("inf")
    assert grouped.ridge_proximity(rolling, field.limit(2)).count() == 0


def test_slowing_down_of_short_and_empty_series(spark):
    rows = spark.createDataFrame([("c", "short", float(i), 1.0 * i) for i in range(20)] + [("c", "null", float(i), None) for i in range(150)], "cohort string, signal_id string, signal_0 double, value double")
    got = {r.signal_id: r for r in grouped.slowing_down(rows).collect()}
    assert all(r.csd_score == 0 and not r.csd_detected and r.variance is None for r in got.values()) and len(got) == 2


def test_velocity_of_a_straight_line(spark):
    rows = spark.createDataFrame([("c", s, float(t), k * t) for s, k in (("a", 1.0), ("b", 2.0)) for t in (0, 1, 3, 6, 10)], "cohort string, signal_id string, signal_0 double, value double")
    got = geometry.velocity_field(rows).collect()
    assert len(got) == 3 and all(r.acceleration_magnitude == pytest.approx(0, abs=1e-9) and r.motion_dimensionality == pytest.approx(2) for r in got)
