"""Queries of geometry, motion, curves and fleets over the line item and event series, and their SQL.

The registered geometry has two features a group: then the spectrum of their correlation r has a closed form, (1 + |r|) and
(1 - |r|) times n / (n - 1), which SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import curves as C
from .operators import fleet as L
from .operators import geometry as G
from .operators import grouped as P
from .operators import windows as W
from .sources import tables as T

PAIRS = {"shape": ["kurtosis", "skewness"], "change": ["trend_r2", "pulsation_index"]}
GEOMETRY = ["eigenvalue_1", "eigenvalue_2", "explained_1", "explained_2", "effective_dim", "total_variance", "eigenvalue_entropy", "eigenvalue_entropy_norm", "eigenvalue_ratio"]
VECTOR = ["shape_effective_dim", "change_effective_dim", "shape_eigenvalue_entropy"]
NEAR = ["rms", "rate_std", "peak"]
LONG, STEP = 128, 64
LIMIT = -0.001


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show, and zero without a sign."""
    zero = lambda c: F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits))
    return df.select(*[zero(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(c: str, digits: int = 6) -> str:
    return f"CASE WHEN round({c}, {digits}) = 0 THEN 0 ELSE round({c}, {digits}) END"


def windows(s, d) -> DataFrame:
    return W.features(T.lineitem(s, d), LONG, STEP)


def geometry(s, d) -> DataFrame:
    return G.cohort_geometry(windows(s, d), PAIRS)


def vectors(s, d) -> DataFrame:
    return G.wide(geometry(s, d))


def _without_conditions(df: DataFrame) -> DataFrame:
    """Where two features all but agree, the ratio of their eigenvalues is noise."""
    return df.drop(*[c for c in df.columns if "condition_number" in c])


def _ridge(s, d) -> DataFrame:
    rolling = windows(s, d).select("cohort", "signal_id", "signal_0_end", F.col("trend_r2").alias("ftle"))
    return P.ridge_proximity(rolling, G.velocity_field(T.lineitem(s, d)))


QUERIES = {
    "cohort_geometry": lambda s, d: rounded(geometry(s, d).select("cohort", "signal_0_end", "engine", "n_signals", *GEOMETRY)),
    "geometry_dynamics": lambda s, d: rounded(G.dynamics(geometry(s, d))),
    "geometry_smoothed": lambda s, d: rounded(G.dynamics(geometry(s, d), smooth=3)),
    "geometry_collapse": lambda s, d: rounded(G.collapse(G.dynamics(geometry(s, d)), LIMIT, 2)),
    "geometry_wide": lambda s, d: rounded(_without_conditions(vectors(s, d))),
    "system_vector": lambda s, d: rounded(G.system_vector(geometry(s, d))),
    "thermodynamics": lambda s, d: rounded(G.thermodynamics(geometry(s, d).where("engine = 'change'"))),
    "signal_dominance": lambda s, d: rounded(G.dominance(G.signal_positions(geometry(s, d))).drop("sign"), 6),
    "signal_geometry": lambda s, d: rounded(G.signal_geometry(windows(s, d), ["rms", "rate_std"])),
    "signal_pairwise": lambda s, d: rounded(L.signal_pairwise(windows(s, d), NEAR), 6),
    "cohort_pairwise": lambda s, d: rounded(L.cohort_pairwise(vectors(s, d), VECTOR).drop("pc1_coloading"), 6),
    "system_geometry": lambda s, d: rounded(L.system_geometry(vectors(s, d), VECTOR[:2]).select("cohort", "signal_0_end", "engine", "n_signals", *GEOMETRY)),
    "velocity_field": lambda s, d: rounded(G.arc_length(G.velocity_field(T.lineitem(s, d))), 5),
    "velocity_components": lambda s, d: rounded(G.velocity_field(T.events(s, d), components=True)),
    "fleet_velocity": lambda s, d: rounded(G.velocity_field(L.fleet_observations(vectors(s, d), "change_effective_dim")), 5),
    "fleet_ftle": lambda s, d: P.ftle_both(L.fleet_observations(vectors(s, d), "change_effective_dim"), least=50),
    "fleet_flow": lambda s, d: P.information_flow(L.fleet_observations(vectors(s, d), "change_effective_dim"), least=30),
    "curve_features": lambda s, d: rounded(C.curve_features(W.features(T.events(s, d), 32, 8), ["cohort", "signal_id"], "signal_0_end", ["rms", "trend_slope"])),
    "critical_slowing_down": lambda s, d: rounded(P.slowing_down(T.events(s, d)), 6),
    "ridge_of_trend": lambda s, d: rounded(_ridge(s, d), 5),
    "fingerprint_windows": lambda s, d: P.fingerprint_windows(T.lineitem(s, d)),
    "fingerprint": lambda s, d: P.fingerprint(T.lineitem(s, d)),
}


def _spectrum(table: str, keys: str, engine: str, f: str, g: str, more: str = "") -> str:
    """Closed form for two columns by keys."""
    return f"""SELECT {keys}, '{engine}' AS engine, n_signals, (1 + q) * k AS eigenvalue_1, (1 - q) * k AS eigenvalue_2, (1 + q) / 2 AS explained_1, (1 - q) / 2 AS explained_2, 2 / (1 + q * q) AS effective_dim, 2 * k AS total_variance,
 -((1 + q) / 2 * log2((1 + q) / 2) + CASE WHEN q < 1 THEN (1 - q) / 2 * log2((1 - q) / 2) ELSE 0 END) AS eigenvalue_entropy, -((1 + q) / 2 * log2((1 + q) / 2) + CASE WHEN q < 1 THEN (1 - q) / 2 * log2((1 - q) / 2) ELSE 0 END) AS eigenvalue_entropy_norm, (1 - q) / (1 + q) AS eigenvalue_ratio
 FROM (SELECT {keys}, count(*) AS n_signals, count(*) / (count(*) - 1) AS k, abs(corr({f}, {g})) AS q FROM ({table}) GROUP BY {keys} HAVING count(*) >= 2 AND stddev_pop({f}) >= 1e-10 AND stddev_pop({g}) >= 1e-10 {more})"""


def _grad(value: str, order: str = "signal_0_end", w: str = "w") -> str:
    t0, t1 = f"({order} - lag({order}) OVER {w})", f"(lead({order}) OVER {w} - {order})"
    f0, f1 = f"lag({value}) OVER {w}", f"lead({value}) OVER {w}"
    return f"CASE WHEN {f0} IS NULL THEN ({f1} - {value}) / {t1} WHEN {f1} IS NULL THEN ({value} - {f0}) / {t0} ELSE ({t0} ^ 2 * {f1} + ({t1} ^ 2 - {t0} ^ 2) * {value} - {t1} ^ 2 * {f0}) / ({t0} * {t1} * ({t0} + {t1})) END"


def _motion(obs: str) -> str:
    w = "WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0)"
    z = f"SELECT *, CASE WHEN sd > 1e-10 THEN (value - m) / sd ELSE value END AS z FROM (SELECT *, avg(value) OVER s AS m, stddev_pop(value) OVER s AS sd FROM ({obs}) WINDOW s AS (PARTITION BY cohort, signal_id))"
    d = f"SELECT *, lead(z) OVER w - z AS dz, greatest(lead(signal_0) OVER w - signal_0, 1e-12) AS dt, lead(signal_0) OVER w AS e FROM ({z}) {w}"
    return f"SELECT *, CASE WHEN e IS NOT NULL THEN dz / dt END AS v FROM ({d})"


COMPONENTS = f"SELECT cohort, signal_id, signal_0 AS signal_0_start, e AS signal_0_end, {_r("v")} AS velocity FROM ({_motion(T.EVENTS)}) WHERE v IS NOT NULL"


def _velocity(obs: str) -> str:
    a = f"SELECT *, (lead(v) OVER w - v) / ((dt + lead(dt) OVER w) / 2) AS a FROM ({_motion(obs)}) WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0)"
    s = f"SELECT *, sum(v * v) OVER r AS vv, count(*) OVER r AS n FROM ({a}) WHERE a IS NOT NULL WINDOW r AS (PARTITION BY cohort, signal_0, e)"
    p = f"SELECT *, (CASE WHEN vv > 1e-24 THEN v * v / vv ELSE 0 END + 1e-12) / (CASE WHEN vv > 1e-24 THEN 1 ELSE 0 END + n * 1e-12) AS p FROM ({s})"
    g = f"SELECT cohort, e AS signal_0_end, signal_0 AS signal_0_start, count(*) AS n_signals, max(vv) AS vv, sum(a * a) AS aa, sum(v * a) AS va, max(abs(v)) AS top, first(signal_id ORDER BY abs(v) DESC, signal_id) AS dominant_motion_signal, first(signal_id ORDER BY abs(a) DESC, signal_id) AS dominant_accel_signal, exp(-sum(p * ln(p + 1e-12))) AS motion_dimensionality FROM ({p}) GROUP BY cohort, signal_0, e"
    h = f"SELECT *, sqrt(vv) AS speed, sqrt(aa) AS acceleration_magnitude, CASE WHEN sqrt(vv) > 1e-12 THEN va / sqrt(vv) ELSE 0 END AS acceleration_parallel, CASE WHEN sqrt(vv) > 1e-12 THEN top / sqrt(vv) ELSE 0 END AS dominant_motion_fraction FROM ({g})"
    return f"SELECT * EXCLUDE (vv, aa, va, top), sqrt(greatest(aa - acceleration_parallel ^ 2, 0)) AS acceleration_perpendicular, sqrt(greatest(aa - acceleration_parallel ^ 2, 0)) / (vv + 1e-12) AS curvature FROM ({h})"


_MOVES = ["speed", "acceleration_magnitude", "acceleration_parallel", "acceleration_perpendicular", "curvature", "dominant_motion_fraction", "motion_dimensionality"]
_MOTION = "cohort, signal_0_end, signal_0_start, n_signals, dominant_motion_signal, dominant_accel_signal, " + ", ".join(f"{_r(c, 5)} AS {c}" for c in _MOVES)


def _pairwise(table: str, keys: str, name: str, fs: list[str]) -> str:
    n = len(fs)
    dot = lambda x, y: "(" + " + ".join(f"{x.format(f)} * {y.format(f)}" for f in fs) + ")"
    mean = {s: "((" + " + ".join(f"{s}.{f}" for f in fs) + f") / {n})" for s in "ab"}
    a, b, ca, cb = "a.{}", "b.{}", "(a.{} - " + mean["a"] + ")", "(b.{} - " + mean["b"] + ")"
    gap = " + ".join(f"(a.{f} - b.{f}) ^ 2" for f in fs)
    over = lambda x, y: f"CASE WHEN sqrt({dot(x, x)}) * sqrt({dot(y, y)}) > 1e-12 THEN {dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)})) END"
    return f"SELECT {', '.join(f'a.{k}' for k in keys.split(', '))}, a.{name} AS {name}_a, b.{name} AS {name}_b, sqrt({gap}) AS distance, {over(a, b)} AS cosine_similarity, {over(ca, cb)} AS correlation FROM ({table}) a JOIN ({table}) b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys.split(', '))} AND a.{name} < b.{name}"


def _slowing() -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) - 1 AS rn, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM ({T.EVENTS}) WHERE value IS NOT NULL AND NOT isnan(value)"
    r = f"SELECT cohort, signal_id, rn, n, value - regr_intercept(value, rn) OVER s - regr_slope(value, rn) OVER s * rn AS r FROM ({rows}) WHERE n >= 100 WINDOW s AS (PARTITION BY cohort, signal_id)"
    w = f"SELECT *, unnest(range(greatest(0, (rn - 40) // 10), rn // 10 + 1)) AS k FROM ({r})"
    e = f"SELECT *, r - avg(r) OVER (PARTITION BY cohort, signal_id, k) AS e FROM ({w}) WHERE k * 10 + 49 < n AND rn >= k * 10 AND rn < k * 10 + 50"
    f = f"SELECT *, lag(e) OVER (PARTITION BY cohort, signal_id, k ORDER BY rn) AS f FROM ({e})"
    m = f"SELECT cohort, signal_id, k, sum(e * f) AS up, sum(e * e) AS ee, avg(e ^ 3) AS m3 FROM ({f}) GROUP BY cohort, signal_id, k"
    q = f"SELECT *, CASE WHEN ee > 1e-10 THEN up / ee END AS ac, ee / 50 AS var, CASE WHEN sqrt(ee / 50) < 1e-10 THEN 0 ELSE m3 / sqrt(ee / 50) ^ 3 END AS skew, max(k) OVER (PARTITION BY cohort, signal_id) AS last FROM ({m})"
    end = lambda c: f"max({c}) FILTER (k = last)"
    r2 = lambda c: f"CASE WHEN var_pop({c}) > 0 THEN corr({c}, k) ^ 2 ELSE 0 END"
    g = f"SELECT cohort, signal_id, {end('ac')} AS ac, {end('var')} AS variance, {end('skew')} AS skewness, regr_slope(ac, k) AS act, {r2('ac')} AS autocorr_trend_r2, regr_slope(var, k) AS vt, {r2('var')} AS variance_trend_r2, {end('var')} / nullif(max(var) FILTER (k = 0), 0) AS ratio FROM ({q}) GROUP BY cohort, signal_id"
    clip = lambda c: f"least(1, greatest(0, {c}))"
    score = f"coalesce((coalesce(0.3 * {clip('ac')}, 0) + 0.25 * {clip('act * 10')} + 0.25 * {clip('vt * 100')} + 0.2 * {clip('(coalesce(ratio, 1) - 1) / 2')}) / (CASE WHEN ac IS NULL THEN 0.7 ELSE 1.0 END), 0)"
    out = f"SELECT *, CASE WHEN act IS NULL THEN 0 ELSE {score} END AS score FROM (SELECT DISTINCT cohort, signal_id FROM ({T.EVENTS})) LEFT JOIN ({g}) USING (cohort, signal_id)"
    named = {"autocorrelation_lag1": "ac", "variance": "variance", "skewness": "skewness", "autocorr_trend": "act", "autocorr_trend_r2": "autocorr_trend_r2", "variance_trend": "vt", "variance_trend_r2": "variance_trend_r2", "variance_ratio": "ratio", "csd_score": "score", "recovery_rate": "CASE WHEN ac > 0 AND ac < 1 THEN -ln(ac) END"}
    return f"SELECT cohort, signal_id, {', '.join(f'{_r(v)} AS {k}' for k, v in named.items())}, coalesce(score > 0.6 AND ac > 0.7 AND vt > 0, false) AS csd_detected FROM ({out})"


def oracle(features: str, events: str) -> dict[str, str]:
    """features: SQL of the line item windows; events: of the event windows."""
    at = "cohort, signal_0_end"
    geo = " UNION ALL ".join(_spectrum(features, at, e, *fs) for e, fs in PAIRS.items())
    by = "WINDOW w AS (PARTITION BY cohort, engine ORDER BY signal_0_end)"

    def dynamics(value: str) -> str:
        out = f"SELECT cohort, engine, signal_0_end, effective_dim, {value} AS x FROM ({geo}) {by}"
        for new, old in (("velocity", "x"), ("acceleration", "velocity"), ("jerk", "acceleration")):
            out = f"SELECT *, {_grad(old)} AS {new} FROM ({out}) {by}"
        return f"SELECT cohort, engine, signal_0_end, x AS effective_dim, velocity, acceleration, jerk, abs(acceleration) / (1 + velocity ^ 2) ^ 1.5 AS curvature, abs(velocity) AS speed FROM ({out})"

    def told(df: str, keys: str, cols: list[str], digits: int = 6) -> str:
        return f"SELECT {keys}, {', '.join(f'{_r(c, digits)} AS {c}' for c in cols)} FROM ({df})"

    moves = ["effective_dim", "velocity", "acceleration", "jerk", "curvature", "speed"]
    smooth = "CASE WHEN count(*) OVER (PARTITION BY cohort, engine) > 3 THEN (effective_dim + coalesce(lag(effective_dim) OVER w, 0) + coalesce(lead(effective_dim) OVER w, 0)) / 3 ELSE effective_dim END"
    low = f"SELECT *, row_number() OVER w AS rn, coalesce(velocity < {LIMIT}, false) AS low FROM ({dynamics('effective_dim')}) {by}"
    runs = f"SELECT cohort, engine, min(signal_0_end) AS onset, max(signal_0_end) AS e, count(*) AS length FROM (SELECT *, rn - sum(low::INT) OVER (PARTITION BY cohort, engine ORDER BY signal_0_end) AS island FROM ({low})) WHERE low GROUP BY cohort, engine, island HAVING count(*) >= 2"
    metrics = ["effective_dim", "total_variance", "eigenvalue_entropy", "eigenvalue_1"]
    wide = f"SELECT {at}, {', '.join(f'max({m}) FILTER (engine = {e!r}) AS {e}_{m}' for e in PAIRS for m in metrics)} FROM ({geo}) GROUP BY {at}"
    wide = f"SELECT *, {', '.join(f'{e}_effective_dim - lag({e}_effective_dim) OVER w AS {e}_eff_dim_rate' for e in PAIRS)} FROM ({wide}) WINDOW w AS (PARTITION BY cohort ORDER BY signal_0_end)"
    system = ", ".join(f"count(*) FILTER (engine = {e!r}) AS {e}_n, " + ", ".join(f"{_r(f'{a}({c}) FILTER (engine = {e!r})')} AS {e}_{n}" for n, a, c in (("mean_dim", "avg", "effective_dim"), ("std_dim", "stddev_pop", "effective_dim"), ("mean_variance", "avg", "total_variance"))) for e in PAIRS)
    change = f"SELECT *, (effective_dim - lag(effective_dim) OVER w) / (signal_0_end - lag(signal_0_end) OVER w) AS v FROM ({geo}) WHERE engine = 'change' WINDOW w AS (PARTITION BY cohort ORDER BY signal_0_end)"
    eigs = f"SELECT cohort, e, sum(e) OVER (PARTITION BY cohort) AS total FROM (SELECT cohort, unnest([eigenvalue_1, eigenvalue_2]) AS e FROM ({change})) WHERE e > 0"
    heat = f"SELECT cohort, avg(effective_dim) AS energy, stddev_samp(effective_dim) AS energy_std, var_pop(v) AS temperature, count(*) AS n_samples FROM ({change}) GROUP BY cohort"
    heat = f"SELECT *, energy - temperature * entropy AS free_energy FROM ({heat}) JOIN (SELECT cohort, -sum(e / total * ln(e / total + 1e-10)) AS entropy FROM ({eigs}) GROUP BY cohort) USING (cohort)"
    loads = " UNION ALL ".join(
        f"SELECT *, '{e}' AS engine, abs((({f} - avg({f}) OVER c) / stddev_pop({f}) OVER c + sign(corr({f}, {g}) OVER c) * ({g} - avg({g}) OVER c) / stddev_pop({g}) OVER c) / sqrt(2)) AS load FROM ({features}) WINDOW c AS (PARTITION BY {at}) QUALIFY stddev_pop({f}) OVER c >= 1e-10 AND stddev_pop({g}) OVER c >= 1e-10"
        for e, (f, g) in PAIRS.items()
    )
    dominant = f"SELECT engine, cohort, signal_id, avg(load) AS mean_abs_pc1, arg_max(load, signal_0_end) AS final_abs_pc1, count(*) AS n_windows FROM ({loads}) GROUP BY engine, cohort, signal_id"
    fs = ["rms", "rate_std"]
    sq = " + ".join(f"({f} - avg({f}) OVER c) ^ 2" for f in fs)
    places = f"SELECT {at}, signal_id, sqrt({sq}) AS distance, sqrt({' + '.join(f'{f} ^ 2' for f in fs)}) AS magnitude, {sq} AS sq FROM ({features}) WINDOW c AS (PARTITION BY {at})"
    gap = " + ".join(f"({f} - avg({f}) OVER c) ^ 2" for f in NEAR)
    norm = "sqrt(" + " + ".join(f"(avg({f}) OVER c) ^ 2" for f in NEAR) + ")"
    about = f"SELECT *, avg(d) OVER (PARTITION BY {at}) AS mean_d FROM (SELECT {at}, signal_id, sqrt({gap}) AS d, CASE WHEN {norm} > 1e-12 THEN ({' + '.join(f'{f} * avg({f}) OVER c' for f in NEAR)}) / {norm} ELSE 0 END AS side FROM ({features}) WINDOW c AS (PARTITION BY {at}))"
    pairs = _pairwise(features, at, "signal_id", NEAR)
    members = f"SELECT 'fleet' AS cohort, cohort AS signal_id, signal_0_end, * EXCLUDE (cohort, signal_0_end) FROM ({wide}) WHERE shape_effective_dim IS NOT NULL AND change_effective_dim IS NOT NULL QUALIFY count(*) OVER (PARTITION BY signal_0_end) > 2"
    fleet = f"SELECT 'fleet' AS cohort, cohort AS signal_id, signal_0_end AS signal_0, change_effective_dim AS value FROM ({wide})"
    rolling = f"SELECT *, CASE WHEN lead(signal_0_end) OVER w IS NOT NULL AND lag(signal_0_end) OVER w IS NOT NULL THEN ftle_gradient - lag(ftle_gradient) OVER w ELSE 0 END AS ftle_acceleration, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM (SELECT cohort, signal_id, signal_0_end, trend_r2 AS ftle, {_grad('trend_r2')} AS ftle_gradient FROM ({features}) WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0_end)) WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0_end)"
    ridge = f"SELECT r.*, speed, speed * ftle_gradient AS urgency FROM ({rolling}) r JOIN ({_velocity(T.LINEITEM)}) v USING (cohort, signal_0_end) WHERE n >= 3"
    ridge = f"SELECT * FROM ({ridge}) WHERE cohort IN (SELECT cohort FROM ({ridge}) GROUP BY cohort HAVING count(DISTINCT signal_0_end) >= 3)"
    return {
        "cohort_geometry": told(geo, f"{at}, engine, n_signals", GEOMETRY),
        "geometry_dynamics": told(dynamics("effective_dim"), "cohort, engine, signal_0_end", moves),
        "geometry_smoothed": told(dynamics(smooth), "cohort, engine, signal_0_end", moves),
        "geometry_collapse": f"SELECT cohort, engine, onset, e AS \"end\", length FROM ({runs}) QUALIFY row_number() OVER (PARTITION BY cohort, engine ORDER BY length DESC, onset) = 1",
        "geometry_wide": told(wide, at, [f"{e}_{m}" for e in PAIRS for m in [*metrics, "eff_dim_rate"]]),
        "system_vector": f"SELECT signal_0_end, {system} FROM ({geo}) GROUP BY signal_0_end",
        "thermodynamics": told(heat, "cohort, n_samples", ["entropy", "energy", "energy_std", "temperature", "free_energy"]),
        "signal_dominance": f"SELECT engine, cohort, signal_id, round(mean_abs_pc1, 6) AS mean_abs_pc1, round(final_abs_pc1, 6) AS final_abs_pc1, n_windows, row_number() OVER (PARTITION BY engine ORDER BY mean_abs_pc1 DESC, cohort, signal_id) AS rank FROM ({dominant})",
        "signal_geometry": f"SELECT {at}, signal_id, round(distance, 6) AS distance, round(magnitude, 6) AS magnitude, round(CASE WHEN sum(sq) OVER c > 1e-12 THEN sq / sum(sq) OVER c END, 6) AS contribution FROM ({places}) WINDOW c AS (PARTITION BY {at})",
        "signal_pairwise": f"SELECT p.cohort, p.signal_0_end, signal_id_a AS signal_a, signal_id_b AS signal_b, round(distance, 6) AS distance, {_r('cosine_similarity')} AS cosine_similarity, {_r('coalesce(correlation, 0)')} AS correlation, a.d < a.mean_d AND b.d < a.mean_d AS both_close_to_state, a.d > a.mean_d AND b.d > a.mean_d AS both_far_from_state, a.side * b.side > 0 AS same_side_of_state, {_r('abs(a.d - b.d)')} AS state_distance_diff, 0.0::DOUBLE AS pc1_coloading, false AS needs_granger FROM ({pairs}) p JOIN ({about}) a ON p.cohort = a.cohort AND p.signal_0_end = a.signal_0_end AND p.signal_id_a = a.signal_id JOIN ({about}) b ON p.cohort = b.cohort AND p.signal_0_end = b.signal_0_end AND p.signal_id_b = b.signal_id",
        "cohort_pairwise": told(f"SELECT *, true AS needs_granger FROM ({_pairwise(f'SELECT cohort, signal_0_end, {chr(44).join(VECTOR)} FROM ({wide}) WHERE ' + ' AND '.join(f'{v} IS NOT NULL' for v in VECTOR), 'signal_0_end', 'cohort', VECTOR)})", "signal_0_end, cohort_a, cohort_b, needs_granger", ["distance", "cosine_similarity", "correlation"], 6),
        "system_geometry": told(_spectrum(members, "cohort, signal_0_end", "system", *VECTOR[:2]), f"{at}, engine, n_signals", GEOMETRY),
        "velocity_field": f"SELECT {_MOTION}, round(sum(speed * (signal_0_end - signal_0_start)) OVER (PARTITION BY cohort ORDER BY signal_0_end ROWS UNBOUNDED PRECEDING), 5) AS arc_length FROM ({_velocity(T.LINEITEM)})",
        "velocity_components": COMPONENTS,
        "fleet_velocity": f"SELECT {_MOTION} FROM ({_velocity(fleet)})",
        "curve_features": C.curve_sql(events, "cohort, signal_id", "signal_0_end", ["rms", "trend_slope"]),
        "critical_slowing_down": _slowing(),
        "ridge_of_trend": f"SELECT cohort, signal_0_end, signal_id, {_r("ftle", 5)} AS ftle, {_r("ftle_gradient", 5)} AS ftle_gradient, {_r("ftle_acceleration", 5)} AS ftle_acceleration, {_r("speed", 5)} AS speed, {_r("urgency", 5)} AS urgency, round(CASE WHEN urgency > 0.001 AND abs(ftle_gradient) > 1e-6 THEN greatest(0, 0.05 - ftle) / (abs(urgency) + 1e-12) ELSE 'inf'::DOUBLE END, 5) AS time_to_ridge, CASE WHEN ftle > 0.05 AND urgency > 0.001 THEN 'critical' WHEN ftle > 0.05 THEN 'elevated' WHEN urgency > 0.001 THEN 'warning' ELSE 'nominal' END AS urgency_class FROM ({ridge})",
    }
