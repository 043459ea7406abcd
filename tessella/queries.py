"""Queries over the benchmark tables, one for each family of operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import geometry_queries as Q
from . import state_queries as V
from .operators import geometry as G
from .operators import grouped as P
from .operators import statistics as S
from .operators import windows as W
from .operators.signal_vector import drop_constant, drop_dead, signal_vector
from .sources import tables as T

WIDTH, STRIDE = 32, 8
SHAPE = ["kurtosis", "skewness", "crest_factor"]


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def window_features(spark, d):
    return rounded(W.features(T.events(spark, d), WIDTH, STRIDE))


def _features_sql(obs: str, width: int, stride: int) -> str:
    f = f"PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW"
    g = f"PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN {width - 2} PRECEDING AND CURRENT ROW"
    return f"""SELECT cohort, signal_id, (rn - {width - 1}) // {stride} AS window_id, signal_0 AS signal_0_end, mean, std, kurtosis, skewness, rms, peak / rms AS crest_factor, peak, hi - lo AS peak_to_peak, (hi - lo) / (abs(mean) + 1e-10) AS pulsation_index,
 trend_slope, trend_r2, mean_rate, rate_std, abs_max_rate FROM (SELECT cohort, signal_id, signal_0, rn, avg(value) OVER f AS mean, stddev_pop(value) OVER f AS std, kurtosis_pop(value) OVER f AS kurtosis,
 (avg(value ^ 3) OVER f - 3 * avg(value) OVER f * avg(value ^ 2) OVER f + 2 * (avg(value) OVER f) ^ 3) / (var_pop(value) OVER f) ^ 1.5 AS skewness, sqrt(avg(value * value) OVER f) AS rms, max(abs(value)) OVER f AS peak, max(value) OVER f AS hi, min(value) OVER f AS lo,
 regr_slope(value, rn) OVER f AS trend_slope, regr_r2(value, rn) OVER f AS trend_r2, avg(d) OVER g AS mean_rate, stddev_pop(d) OVER g AS rate_std, max(abs(d)) OVER g AS abs_max_rate
 FROM (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) - 1 AS rn, value - lag(value) OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS d FROM ({obs})) WINDOW f AS ({f}), g AS ({g}))
 WHERE rn >= {width - 1} AND (rn - {width - 1}) % {stride} = 0"""


_FEATURES = _features_sql(T.EVENTS, WIDTH, STRIDE)
FEATURE_NAMES = ["mean", "std", "kurtosis", "skewness", "rms", "crest_factor", "peak", "peak_to_peak", "pulsation_index", "trend_slope", "trend_r2", "mean_rate", "rate_std", "abs_max_rate"]


def _round(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 8) AS {c}" for c in cols)


def window_summary(spark, d):
    return rounded(W.summarize(W.features(T.events(spark, d), WIDTH, STRIDE), ["rms", "trend_slope", "kurtosis"]))


def _summary_sql() -> str:
    out = []
    for m in ("rms", "trend_slope", "kurtosis"):
        cv = f"CASE WHEN abs(avg({m})) > 1e-10 THEN stddev_samp({m}) / abs(avg({m})) ELSE stddev_samp({m}) END"
        out.append(f"round(avg({m}), 8) AS {m}_mean, round(stddev_samp({m}), 8) AS {m}_std, round({cv}, 8) AS {m}_cv, {cv} > 0.10 AS {m}_varies")
    return f"SELECT cohort, signal_id, count(*) AS n_windows, {', '.join(out)} FROM ({_FEATURES}) GROUP BY cohort, signal_id"


_KEYS = "cohort, signal_id"
_Q = lambda p: f"quantile_cont(value, {p})"
_SUM = f"SELECT cohort, signal_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, {_Q(0.5)} AS median, {_Q(0.25)} AS q1, {_Q(0.75)} AS q3, {_Q(0.75)} - {_Q(0.25)} AS iqr, var_samp(value) AS variance, stddev_samp(value) / nullif(abs(avg(value)), 0) AS cv FROM ({T.EVENTS}) GROUP BY cohort, signal_id"
_SUM_COLS = ["mean", "std", "min", "max", "range", "median", "q1", "q3", "iqr", "variance", "cv"]


def _normal_sql(center: str, scale: str, out: str = "(value - center) / scale") -> str:
    return f"SELECT cohort, signal_id, signal_0, round(value, 8) AS value, round(center, 8) AS center, round(scale, 8) AS scale, round({out}, 8) AS normalized FROM (SELECT o.*, center, CASE WHEN scale < 1e-10 THEN 1 ELSE scale END AS scale FROM ({T.EVENTS}) o JOIN (SELECT cohort, signal_id, {center} AS center, {scale} AS scale FROM ({T.EVENTS}) GROUP BY cohort, signal_id) USING (cohort, signal_id))"


_MADS = f"SELECT o.*, median FROM ({T.EVENTS}) o JOIN (SELECT cohort, signal_id, {_Q(0.5)} AS median FROM ({T.EVENTS}) GROUP BY cohort, signal_id) USING (cohort, signal_id)"
_MAD = f"SELECT cohort, signal_id, quantile_cont(abs(value - median), 0.5) AS mad FROM ({_MADS}) GROUP BY cohort, signal_id"


def _prints(spark, d):
    return S.gaussian_fingerprint(W.features(T.events(spark, d), WIDTH, STRIDE), SHAPE + ["rms"])


def _prints_sql() -> str:
    fs = SHAPE + ["rms"]
    agg = ", ".join(f"avg({f}) AS mean_{f}, stddev_samp({f}) AS std_{f}" for f in fs)
    ratios = [f"CASE WHEN abs(mean_{f}) > 1e-10 THEN std_{f} / abs(mean_{f}) END" for f in fs]
    known = " + ".join(f"(({r}) IS NOT NULL)::INT" for r in ratios)
    return f"SELECT *, ({' + '.join(f'coalesce({r}, 0)' for r in ratios)}) / nullif({known}, 0) AS fingerprint_volatility FROM (SELECT cohort, signal_id, count(*) AS n_windows, {agg} FROM ({_FEATURES}) GROUP BY cohort, signal_id)"


def _similar_sql() -> str:
    fs = SHAPE + ["rms"]
    ds = [f"CASE WHEN a.std_{f} > 0 AND b.std_{f} > 0 THEN 0.25 * (a.mean_{f} - b.mean_{f}) ^ 2 / (a.std_{f} ^ 2 + b.std_{f} ^ 2) + 0.5 * ln((a.std_{f} ^ 2 + b.std_{f} ^ 2) / (2 * sqrt(a.std_{f} ^ 2 * b.std_{f} ^ 2))) END" for f in fs]
    known = " + ".join(f"(({x}) IS NOT NULL)::INT" for x in ds)
    return f"SELECT cohort, signal_a, signal_b, n_features, round(distance, 8) AS distance, round(exp(-distance), 8) AS similarity FROM (SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, {known} AS n_features, ({' + '.join(f'coalesce({x}, 0)' for x in ds)}) / nullif({known}, 0) AS distance FROM ({_prints_sql()}) a JOIN ({_prints_sql()}) b ON a.cohort = b.cohort AND a.signal_id < b.signal_id)"


LONG, STEP = 128, 64


def _centroid_obs(spark, d):
    """Aligned windows: the four line item signals."""
    return W.features(T.lineitem(spark, d), LONG, STEP)


_LFEATURES = _features_sql(T.LINEITEM, LONG, STEP)


def _centroid_sql() -> str:
    fs = ["rms", "rate_std"]
    mean = ", ".join(f"avg({f}) OVER (PARTITION BY cohort, signal_0_end) AS s_{f}" for f in fs)
    d = "sqrt(" + " + ".join(f"({f} - s_{f}) ^ 2" for f in fs) + ")"
    return f"SELECT cohort, signal_0_end, count(*) AS n_signals, round(avg({d}), 8) AS mean_distance, round(max({d}), 8) AS max_distance, round(stddev_pop({d}), 8) AS std_distance, {', '.join(f'round(max(s_{f}), 8) AS state_{f}' for f in fs)} FROM (SELECT *, {mean} FROM ({_LFEATURES})) GROUP BY cohort, signal_0_end"


def _segments(spark, d):
    o = S.segments(T.events(spark, d), [("first", 0, 500), ("rest", 500, None)])
    return rounded(o.groupBy("segment", "cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")))


def _lifecycle(spark, d):
    return rounded(S.lifecycle(T.events(spark, d)).groupBy("cohort", "signal_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def _gradient(spark, d):
    o = T.events(spark, d)
    return rounded(o.select("cohort", "signal_id", "signal_0", W.gradient(F.col("value"), F.col("signal_0"), W.ordered()).alias("gradient")))


_GRAD = f"""SELECT cohort, signal_id, signal_0, round(CASE WHEN f0 IS NULL THEN (f1 - value) / (t1 - signal_0) WHEN f1 IS NULL THEN (value - f0) / (signal_0 - t0)
 ELSE ((signal_0 - t0) ^ 2 * f1 + ((t1 - signal_0) ^ 2 - (signal_0 - t0) ^ 2) * value - (t1 - signal_0) ^ 2 * f0) / ((signal_0 - t0) * (t1 - signal_0) * (t1 - t0)) END, 8) AS gradient
 FROM (SELECT *, lag(value) OVER w AS f0, lead(value) OVER w AS f1, lag(signal_0) OVER w AS t0, lead(signal_0) OVER w AS t1 FROM ({T.EVENTS}) WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0))"""


def _tail(spark, d):
    return rounded(W.tail(T.events(spark, d), 32))


def _baseline(spark, d):
    return rounded(G.baseline(T.events(spark, d)))


def _scores(spark, d):
    o = T.lineitem(spark, d)
    return rounded(G.observation_scores(o, G.baseline(o)))


_BASE = "SELECT cohort, signal_id, avg(value) AS base_mean, stddev_samp(value) AS base_std, count(*) AS base_n FROM (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) AS r, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM ({obs})) WHERE r <= ceil(n * 0.2) GROUP BY cohort, signal_id"
_ZB = f"SELECT o.cohort, o.signal_0, CASE WHEN base_std > 1e-10 THEN (value - base_mean) / base_std END AS z FROM ({T.LINEITEM}) o JOIN ({_BASE.format(obs=T.LINEITEM)}) USING (cohort, signal_id)"


ENGINE_SETS = {
    "spectral": ["spectral", "frequency_bands", "fundamental_freq", "harmonics", "thd", "snr"],
    "envelope": ["envelope", "phase_coherence", "hilbert_stability", "wavelet_stability"],
    "memory": ["hurst", "dfa", "memory", "acf_decay", "variance_ratio", "variance_growth", "adf_stat", "mann_kendall"],
    "complexity": ["complexity", "lof", "time_constant", "garch", "hmm"],
    "recurrence": ["rqa", "attractor", "lyapunov", "dmd"],
    "discrete": ["level_count", "level_histogram", "transition_matrix", "duty_cycle", "mean_time_between", "dwell_times", "entropy", "cycle_counting", "basin"],
    "typology": ["typology"],
}


def _engines(names: list[str]):
    return lambda spark, d: drop_dead(signal_vector(T.events(spark, d), names, 64, 32))


def _geometry(spark, d):
    return G.cohort_geometry(_centroid_obs(spark, d))


def _flow(spark, d):
    return P.information_flow(T.lineitem(spark, d))


def _flow_delta(spark, d):
    o = T.lineitem(spark, d)
    return P.flow_delta(*(P.granger_links(o.where(c)) for c in ("signal_0 <= 400", "signal_0 > 400")))


def _ridge(spark, d):
    o = T.lineitem(spark, d)
    return P.ridge_proximity(P.ftle_rolling(o), G.velocity_field(o))


def _fleet(spark, d):
    return P.trajectory_library(W.features(T.orders(spark, d), WIDTH, STRIDE).groupBy("cohort", "window_id").agg(F.avg("rms").alias("rms"), F.avg("rate_std").alias("rate_std")), "window_id", ["rms", "rate_std"])


QUERIES = {
    "window_features": window_features,
    "window_summary": window_summary,
    "sql_statistics": lambda s, d: rounded(S.summary(T.events(s, d))),
    "sql_zscore": lambda s, d: rounded(S.zscore_departures(T.events(s, d))),
    "sql_mad_departure": lambda s, d: rounded(S.mad_departures(T.events(s, d))),
    "sql_correlation": lambda s, d: rounded(S.correlations(T.lineitem(s, d))),
    "sql_gaussian_fingerprint": lambda s, d: rounded(_prints(s, d)),
    "sql_gaussian_similarity": lambda s, d: rounded(S.gaussian_similarity(_prints(s, d), SHAPE + ["rms"])),
    "normalize_zscore": lambda s, d: rounded(S.normalize(T.events(s, d), "zscore")),
    "normalize_robust": lambda s, d: rounded(S.normalize(T.events(s, d), "robust")),
    "normalize_mad": lambda s, d: rounded(S.normalize(T.events(s, d), "mad")),
    "normalize_minmax": lambda s, d: rounded(S.normalize(T.events(s, d), "minmax")),
    "normalize_recommend": lambda s, d: rounded(S.recommend(T.events(s, d))),
    "validate_observations": lambda s, d: S.validate(T.events(s, d)),
    "constant_signals": lambda s, d: rounded(S.constant_signals(T.lineitem(s, d))),
    "segments": _segments,
    "lifecycle": _lifecycle,
    "gradient": _gradient,
    "tail": _tail,
    "cohort_centroid": lambda s, d: rounded(G.centroid(_centroid_obs(s, d), ["rms", "rate_std"])),
    "cohort_baseline": _baseline,
    "observation_geometry": _scores,
    "signal_positions": lambda s, d: G.signal_positions(_geometry(s, d)),
    "feature_loadings": lambda s, d: G.feature_loadings(_geometry(s, d)),
    "breaks": lambda s, d: P.breaks(T.events(s, d)),
    "break_summary": lambda s, d: P.summarize_breaks(P.breaks(T.events(s, d))),
    "ftle": lambda s, d: P.ftle(T.events(s, d)),
    "ftle_both": lambda s, d: P.ftle_both(T.orders(s, d)),
    "ftle_intervention": lambda s, d: P.ftle_around(T.orders(s, d), 250.0),
    "ftle_rolling": lambda s, d: P.ftle_rolling(T.orders(s, d)),
    "lyapunov": lambda s, d: P.ftle(T.events(s, d)),
    "ridge_proximity": _ridge,
    "saddle_detection": lambda s, d: P.saddles(T.events(s, d)),
    "attractor_reconstruction": lambda s, d: P.attractors(T.events(s, d)),
    "trajectory_sensitivity": lambda s, d: P.sensitivities(T.lineitem(s, d)),
    "persistent_homology": lambda s, d: P.homology(T.lineitem(s, d)),
    "information_flow": _flow,
    "information_flow_delta": _flow_delta,
    "trajectory_library": _fleet,
} | {f"engines_{k}": _engines(v) for k, v in ENGINE_SETS.items()} | Q.QUERIES | V.QUERIES

_Z = f"SELECT o.*, (value - mean) / nullif(std, 0) AS zscore FROM ({T.EVENTS}) o JOIN ({_SUM}) USING (cohort, signal_id)"
ORACLE = {
    "window_features": f"SELECT cohort, signal_id, window_id, signal_0_end, {_round(FEATURE_NAMES)} FROM ({_FEATURES})",
    "window_summary": _summary_sql(),
    "sql_statistics": f"SELECT cohort, signal_id, n, {_round(_SUM_COLS)} FROM ({_SUM})",
    "sql_zscore": f"SELECT cohort, signal_id, signal_0, round(value, 8) AS value, round(zscore, 8) AS zscore, coalesce(abs(zscore) > 3, false) AS is_departure FROM ({_Z})",
    "sql_mad_departure": f"SELECT cohort, signal_id, signal_0, round(value, 8) AS value, round(median, 8) AS median, round(mad, 8) AS mad, round(s, 8) AS score, CASE WHEN s >= 5 THEN 'extreme' WHEN s >= 3.5 THEN 'severe' WHEN s >= 2.5 THEN 'moderate' WHEN s >= 2 THEN 'mild' ELSE 'normal' END AS severity FROM (SELECT *, abs(value - median) / nullif(1.4826 * mad, 0) AS s FROM ({_MADS}) JOIN ({_MAD}) USING (cohort, signal_id))",
    "sql_correlation": f"SELECT a.cohort, a.signal_id AS signal_a, b.signal_id AS signal_b, count(*) AS n, round(corr(a.value, b.value), 8) AS correlation FROM ({T.LINEITEM}) a JOIN ({T.LINEITEM}) b ON a.cohort = b.cohort AND a.signal_0 = b.signal_0 AND a.signal_id < b.signal_id GROUP BY 1, 2, 3 HAVING count(*) >= 10",
    "sql_gaussian_fingerprint": f"SELECT cohort, signal_id, n_windows, {_round([f'{k}_{f}' for f in SHAPE + ['rms'] for k in ('mean', 'std')] + ['fingerprint_volatility'])} FROM ({_prints_sql()})",
    "sql_gaussian_similarity": _similar_sql(),
    "normalize_zscore": _normal_sql("avg(value)", "stddev_pop(value)"),
    "normalize_robust": _normal_sql(_Q(0.5), f"{_Q(0.75)} - {_Q(0.25)}"),
    "normalize_mad": f"SELECT cohort, signal_id, signal_0, round(value, 8) AS value, round(median, 8) AS center, round(s, 8) AS scale, round((value - median) / s, 8) AS normalized FROM (SELECT *, CASE WHEN 1.4826 * mad < 1e-10 THEN 1 ELSE 1.4826 * mad END AS s FROM ({_MADS}) JOIN ({_MAD}) USING (cohort, signal_id))",
    "normalize_minmax": _normal_sql("min(value)", "max(value) - min(value)"),
    "validate_observations": f"SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (isnan(value) OR isinf(value)) AS n_not_finite, count(DISTINCT signal_id) AS n_signals, count(DISTINCT cohort) AS n_cohorts FROM ({T.EVENTS})",
    "constant_signals": f"SELECT cohort, signal_id, count(value) AS n, round(coalesce(stddev_pop(value), 0), 8) AS std, coalesce(stddev_pop(value), 0) < 1e-10 AS is_constant FROM ({T.LINEITEM}) GROUP BY cohort, signal_id",
    "segments": f"SELECT segment, cohort, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std FROM (SELECT *, 'first' AS segment FROM ({T.EVENTS}) WHERE signal_0 BETWEEN 0 AND 500 UNION ALL SELECT *, 'rest' FROM ({T.EVENTS}) WHERE signal_0 >= 500) GROUP BY segment, cohort",
    "lifecycle": f"SELECT cohort, signal_id, phase, count(*) AS n, round(avg(value), 8) AS mean FROM (SELECT *, CASE WHEN rn < n // 3 THEN 'early' WHEN rn >= n - n // 3 THEN 'late' ELSE 'mid' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) - 1 AS rn, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM ({T.EVENTS}))) GROUP BY cohort, signal_id, phase",
    "gradient": _GRAD,
    "tail": f"SELECT cohort, signal_id, signal_0, round(value, 8) AS value FROM (SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0 DESC) AS r FROM ({T.EVENTS})) WHERE r <= 32",
    "cohort_centroid": _centroid_sql(),
    "cohort_baseline": f"SELECT cohort, signal_id, round(base_mean, 8) AS base_mean, round(base_std, 8) AS base_std, base_n FROM ({_BASE.format(obs=T.EVENTS)})",
    "observation_geometry": f"SELECT cohort, signal_0, count(z) AS n_signals, round(sqrt(sum(z * z)), 8) AS distance, round(sqrt(sum(z * z) / nullif(count(z), 0)), 8) AS distance_norm, round(max(abs(z)), 8) AS max_z FROM ({_ZB}) GROUP BY cohort, signal_0",
} | Q.oracle(_LFEATURES, _FEATURES)
ORACLE |= V.oracle(_LFEATURES, _FEATURES, ORACLE)
