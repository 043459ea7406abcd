"""Queries of states, rolling values and trajectory features over the benchmark tables, and their SQL.

Where one operator reads another's result, both sides read it rounded, so that no order of a sum shows. The parts have two signals,
whose spectrum has a closed form in their correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry_queries as Q
from .geometry_queries import _r, rounded
from .operators import axes as A
from .operators import field as E
from .operators import geometry as G
from .operators import rolling as R
from .operators import state as S
from .operators import windows as W
from .sources import tables as T

VIEWED = ["rms", "rate_std"]
#: More than the inputs' six, so that no tie is rounded again.
DIGITS = 7


#: Means of few rounded numbers end in a five where they are cut; moved a little, they fall to one side on both engines.
NUDGE = 3.3e-10


def _nudged(df: DataFrame) -> DataFrame:
    return rounded(df.select(*[(F.col(c) + NUDGE).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), DIGITS)


def _n(c: str) -> str:
    return _r(f"(({c}) + {NUDGE})", DIGITS)


def _typology(s, d) -> DataFrame:
    return T.parts(s, d).groupBy("signal_id").agg((F.stddev_pop("value") < 1e-10).alias("is_constant"))


def _geometry(s, d) -> DataFrame:
    """Rounded, with the condition number of what is left."""
    return Q.QUERIES["cohort_geometry"](s, d).withColumn("condition_number", F.when(F.col("eigenvalue_2") > 0, F.col("eigenvalue_1") / F.when(F.col("eigenvalue_2") > 0, F.col("eigenvalue_2"))))


def _signature(s, d, engine: str) -> DataFrame:
    return rounded(A.signatures(_geometry(s, d), Q.QUERIES["geometry_dynamics"](s, d), Q.QUERIES["velocity_field"](s, d), engine), DIGITS)


def _cross(s, d) -> DataFrame:
    both = A.cross_axis_features({e: A.axis_features(_signature(s, d, e), e) for e in ("shape", "change")})
    return both.select("cohort", *[c for c in both.columns if c.startswith("cross_")]).drop("cross_trajectory_agreement", "cross_n_distinct_trajectories")


def _spectrum_of_parts(s, d) -> DataFrame:
    b = S.baseline_spectrum(T.parts(s, d))
    return b.select("cohort", "n_baseline", "effective_dim", "total_variance", "signal_id", "centroid", "std", *[F.get("directions", F.lit(i)).alias(f"pc{i + 1}") for i in (0, 1)], *[F.get("eigenvalues", F.lit(i)).alias(f"eigenvalue_{i + 1}") for i in (0, 1)])


def _views(s, d) -> DataFrame:
    w = Q.windows(s, d).withColumn("signal_0_center", F.col("signal_0_end") - (Q.LONG - 1) / 2)
    return S.state_vector(w, {"motion": VIEWED})


QUERIES = {
    "interpolated": lambda s, d: rounded(S.gridded(T.events(s, d))),
    "rolling_departures": lambda s, d: rounded(R.rolling_departures(T.events(s, d)), 9),
    "rolling_statistics": lambda s, d: rounded(R.rolling(T.events(s, d), "statistics", 32, 8)),
    "rolling_trend": lambda s, d: rounded(R.rolling(T.events(s, d), "trend", 32, 8).drop("rolling_cusum_range")),
    "window_changes": lambda s, d: rounded(R.changes(T.events(s, d), 32, 8)),
    "window_trend": lambda s, d: rounded(R.trend_of(rounded(W.features(T.events(s, d), 32, 8)), "rms", "signal_0_end", ["cohort", "signal_id"])),
    "active_signals": lambda s, d: R.active(T.parts(s, d), _typology(s, d)).groupBy("cohort", "signal_id").agg(F.count(F.lit(1)).alias("n")),
    "weighted_centroid": lambda s, d: rounded(S.weighted_centroid(Q.windows(s, d), VIEWED, "peak")),
    "signal_stability": lambda s, d: S.signal_stability(T.lineitem(s, d)),
    "sensor_eigen": lambda s, d: rounded(S.sensor_eigen(T.parts(s, d)).select("cohort", "signal_0_start", "signal_0_end", "signal_0_center", "n_signals", "n_samples", "effective_dim", "eff_dim_entropy", "eigenvalue_entropy", "eigenvalue_entropy_normalized", "total_variance", "ratio_2_1", "energy_concentration", "eigenvalue_0", "eigenvalue_1", "explained_ratio_0", "explained_ratio_1")),
    "segment_comparison": lambda s, d: rounded(S.segment_comparison(T.parts(s, d))),
    "baseline_spectrum": lambda s, d: rounded(_spectrum_of_parts(s, d)),
    "baseline_scores": lambda s, d: rounded(S.baseline_scores(T.parts(s, d), S.baseline_spectrum(T.parts(s, d)))),
    "state_vector": _views,
    "trajectory_signatures": lambda s, d: _signature(s, d, "change"),
    "axis_features": lambda s, d: _nudged(A.axis_features(_signature(s, d, "change"), "time")),
    "subwindow_features": lambda s, d: _nudged(A.subwindow_features(_geometry(s, d), "time")),
    "cross_axis_features": lambda s, d: _nudged(_cross(s, d)),
    "rolling_lyapunov": lambda s, d: R.rolling_lyapunov(T.orders(s, d)),
    "rolling_saddles": lambda s, d: R.rolling_saddles(T.orders(s, d)),
    "rolling_sensitivity": lambda s, d: R.rolling_sensitivity(T.parts(s, d), 40, 10, 5),
    "ftle_field": lambda s, d: E.ftle_field(_parts_geometry(s, d)),
    "ftle_basins": lambda s, d: E.basins(_parts_geometry(s, d)),
}


def _parts_geometry(s, d) -> DataFrame:
    """Spectra of the brands' two signals over time: 25 cohorts, one engine."""
    return S.sensor_eigen(T.parts(s, d), 10, 2, 10).where("effective_dim is not null").select("cohort", "signal_0_end", F.lit("sensors").alias("engine"), F.col("eigenvalue_0").alias("eigenvalue_1"), F.col("eigenvalue_1").alias("eigenvalue_2"))


def _told(df: str, keys: str, cols: list[str], digits: int = 6) -> str:
    return f"SELECT {keys}, {', '.join(f'{_r(c, digits)} AS {c}' for c in cols)} FROM ({df})"


_SERIES = "cohort, signal_id"


def _interpolated() -> str:
    grid = f"SELECT c.cohort, signal_id, signal_0 FROM (SELECT DISTINCT cohort, signal_0 FROM ({T.EVENTS})) c JOIN (SELECT DISTINCT cohort, signal_id FROM ({T.EVENTS})) s ON c.cohort = s.cohort"
    df = f"SELECT g.*, value, row_number() OVER (PARTITION BY g.cohort, g.signal_id ORDER BY g.signal_0) AS i FROM ({grid}) g LEFT JOIN ({T.EVENTS}) o ON g.cohort = o.cohort AND g.signal_id = o.signal_id AND g.signal_0 = o.signal_0"
    df = f"SELECT *, CASE WHEN value IS NOT NULL THEN i END AS place FROM ({df})"
    ends = [f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a{n}, first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{n}" for c, n in (("place", "i"), ("value", "v"))]
    df = f"SELECT *, {', '.join(ends)} FROM ({df}) WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0)"
    return _told(f"SELECT cohort, signal_id, signal_0, CASE WHEN value IS NOT NULL THEN value WHEN av IS NULL THEN bv WHEN bv IS NULL THEN av ELSE av + (bv - av) * (i - ai) / (bi - ai) END AS value FROM ({df})", f"{_SERIES}, signal_0", ["value"])


def _departures() -> str:
    w = "WINDOW w AS (PARTITION BY cohort, signal_id ORDER BY signal_0 ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)"
    df = f"SELECT *, quantile_cont(value, 0.5) OVER w AS rolling_median FROM ({T.EVENTS}) {w}"
    df = f"SELECT *, quantile_cont(abs(value - rolling_median), 0.5) OVER w AS rolling_mad FROM ({df}) {w}"
    df = f"SELECT *, CASE WHEN rolling_mad > 1e-10 THEN 0.6745 * (value - rolling_median) / rolling_mad ELSE 0 END AS mad_score FROM ({df})"
    return _told(f"SELECT *, abs(mad_score) > 3.5 AS is_departure FROM ({df})", f"{_SERIES}, signal_0, is_departure", ["value", "rolling_median", "rolling_mad", "mad_score"], 9)


def _rolling(features: str, cols: dict[str, str]) -> str:
    return f"SELECT o.cohort, o.signal_id, o.signal_0, {_r('value')} AS value, {', '.join(f'{_r(v)} AS rolling_{c}' for c, v in cols.items())} FROM ({T.EVENTS}) o LEFT JOIN ({features}) f ON o.cohort = f.cohort AND o.signal_id = f.signal_id AND o.signal_0 = f.signal_0_end"


def _changes() -> str:
    p = "PARTITION BY cohort, signal_id, k"
    rows = f"SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0) - 1 AS rn, count(*) OVER (PARTITION BY cohort, signal_id) AS n FROM ({T.EVENTS})"
    held = f"SELECT * FROM (SELECT *, unnest(range(greatest(0, (rn - 24) // 8), rn // 8 + 1)) AS k FROM ({rows})) WHERE k * 8 + 31 < n AND rn >= k * 8 AND rn < k * 8 + 32"
    few = f"SELECT cohort, signal_id, k, count(DISTINCT value) <= 10 AS few FROM ({held}) GROUP BY cohort, signal_id, k"
    df = f"SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS sd, min(value) OVER p AS lo, max(value) OVER p AS hi FROM ({held}) JOIN ({few}) USING (cohort, signal_id, k) WINDOW p AS ({p})"
    level = " + ".join([f"(lo + {j} * ((hi - lo) / 10) < value)::INT" for j in range(10)] + ["(hi < value)::INT"])
    df = f"SELECT *, CASE WHEN few THEN value ELSE {level} END AS level, value / CASE WHEN sd > 0 THEN sd ELSE 1 END AS y FROM ({df})"
    back = {"zero": "sign(value)", "mean": "sign(value - m)", "level": "level"}
    df = f"SELECT *, y - lag(y) OVER o AS roc, {', '.join(f'({c} <> lag({c}) OVER o)::INT AS t_{n}' for n, c in back.items())} FROM ({df}) WINDOW o AS ({p} ORDER BY rn)"
    return f"SELECT cohort, signal_id, k AS window_id, max(signal_0) AS signal_0_end, sum(t_zero) AS zero_crossings, sum(t_mean) AS mean_crossings, sum(t_level) AS transition_count, {_r('avg(roc)')} AS mean_roc, {_r('stddev_pop(roc)')} AS std_roc, {_r('max(abs(roc))')} AS max_roc FROM ({df}) GROUP BY cohort, signal_id, k"


def _closed(q: str, k: str) -> dict[str, str]:
    """Measures of the spectrum of two z-scored columns: q = |correlation|, k = n / (n - 1)."""
    up, low = f"((1 + {q}) / 2)", f"((1 - {q}) / 2)"
    h = lambda log: f"-({up} * {log}({up}) + CASE WHEN {q} < 1 THEN {low} * {log}({low}) ELSE 0 END)"
    return {"effective_dim": f"2 / (1 + {q} * {q})", "eff_dim_entropy": f"exp({h('ln')})", "eigenvalue_entropy": h("log2"), "total_variance": f"2 * {k}", "ratio_2_1": f"(1 - {q}) / (1 + {q})", "energy_concentration": up, "first": f"(1 + {q}) * {k}", "second": f"(1 - {q}) * {k}", "explained_1": low}


def _sensors() -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY signal_0) - 1 AS rn, least(30, count(*) OVER (PARTITION BY cohort)) AS e, count(*) OVER (PARTITION BY cohort) AS n FROM ({T.PARTS_WIDE})"
    held = f"SELECT * FROM (SELECT *, unnest(range(0, (n - e) // 5 + 1)) AS k FROM ({rows})) WHERE rn >= k * 5 AND rn < k * 5 + e"
    means = f"SELECT cohort, k, avg(a) AS a, avg(b) AS b, min(signal_0) AS s, max(signal_0) AS t FROM ({held}) GROUP BY cohort, k QUALIFY count(*) OVER (PARTITION BY cohort) >= 3"
    df = f"SELECT cohort, s, t, count(*) OVER w AS look, count(*) OVER w / (count(*) OVER w - 1) AS kk, abs(corr(a, b) OVER w) AS q, least(stddev_pop(a) OVER w, stddev_pop(b) OVER w) AS sd FROM ({means}) WINDOW w AS (PARTITION BY cohort ORDER BY k ROWS 29 PRECEDING)"
    c = _closed("q", "kk")
    cols = {**{n: c[n] for n in ("effective_dim", "eff_dim_entropy", "eigenvalue_entropy", "total_variance", "ratio_2_1", "energy_concentration")}, "eigenvalue_entropy_normalized": c["eigenvalue_entropy"], "eigenvalue_0": c["first"], "eigenvalue_1": c["second"], "explained_ratio_0": c["energy_concentration"], "explained_ratio_1": c["explained_1"]}
    ok = "look >= 3 AND sd >= 1e-10"
    return f"SELECT cohort, s AS signal_0_start, t AS signal_0_end, (s + t) / 2 AS signal_0_center, CASE WHEN {ok} THEN look ELSE 2 END AS n_signals, look AS n_samples, {', '.join(f'CASE WHEN {ok} THEN {_r(v)} END AS {n}' for n, v in cols.items())} FROM ({df})"


def _segments() -> str:
    rows = f"SELECT *, trunc(max(signal_0) OVER (PARTITION BY cohort) * 0.20) AS split FROM ({T.PARTS_WIDE})"
    rows = f"SELECT *, CASE WHEN signal_0 BETWEEN 0 AND split THEN 0 WHEN signal_0 >= split + 1 THEN 1 END AS segment FROM ({rows})"
    c = _closed("q", "k")
    one = f"SELECT cohort, segment, n AS n_samples, {c['effective_dim']} AS eff_dim, {c['first']} AS eigenvalue_1, {c['energy_concentration']} AS explained_1, (1 + q) / (1 - q) AS condition_number, {c['ratio_2_1']} AS spectral_gap FROM (SELECT cohort, segment, count(*) AS n, count(*) / (count(*) - 1) AS k, abs(corr(a, b)) AS q FROM ({rows}) WHERE segment IS NOT NULL GROUP BY cohort, segment HAVING count(*) >= 5)"
    cols = ["eff_dim", "eigenvalue_1", "explained_1", "condition_number", "spectral_gap"]
    two = ", ".join(f"{_r(f'x.{n}')} AS {n}_a, {_r(f'y.{n}')} AS {n}_b" for n in cols)
    return f"SELECT x.cohort, 'pre' AS segment_a, 'post' AS segment_b, x.n_samples AS n_samples_a, y.n_samples AS n_samples_b, {two}, {_r('y.eff_dim - x.eff_dim')} AS eff_dim_delta, {_r('y.eigenvalue_1 - x.eigenvalue_1')} AS eigenvalue_1_delta FROM ({one}) x JOIN ({one}) y ON x.cohort = y.cohort AND x.segment = 0 AND y.segment = 1"


_EARLY = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY signal_0) AS r, count(*) OVER (PARTITION BY cohort) AS n FROM ({T.PARTS_WIDE})) WHERE n >= 5 AND r <= greatest(3, floor(n * 0.2))"
_FLEET = f"SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, sign(corr(a, b)) AS g, abs(corr(a, b)) AS q, count(*) / (count(*) - 1) AS k FROM ({_EARLY})"


def _base() -> str:
    c = _closed("q", "k")
    one = lambda n, m, s, p, o: f"SELECT 'fleet' AS cohort, n AS n_baseline, {_r(c['effective_dim'])} AS effective_dim, {_r(c['total_variance'])} AS total_variance, '{n}' AS signal_id, {_r(m)} AS centroid, {_r(s)} AS std, {_r(p)} AS pc1, {_r(o)} AS pc2, {_r(c['first'])} AS eigenvalue_1, {_r(c['second'])} AS eigenvalue_2 FROM ({_FLEET})"
    return one("retailprice", "ma", "sa", "1 / sqrt(2)", "1 / sqrt(2)") + " UNION ALL " + one("size", "mb", "sb", "g / sqrt(2)", "-g / sqrt(2)")


def _scores() -> str:
    z = f"SELECT cohort, signal_0, a, b, (a - ma) / sa AS za, (b - mb) / sb AS zb, g, q, k FROM ({T.PARTS_WIDE}) CROSS JOIN ({_FLEET})"
    p = f"SELECT *, (za + g * zb) / sqrt(2) AS p1, (za - g * zb) / sqrt(2) AS p2, sqrt(za * za + zb * zb) AS d FROM ({z})"
    cols = {"centroid_distance": "d", "centroid_distance_norm": "d / sqrt(2)", "pc1_projection": "p1", "pc2_projection": "p2", "mahalanobis_approx": "sqrt(p1 * p1 / ((1 + q) * k) + p2 * p2 / ((1 - q) * k))", "sensor_norm": "sqrt(a * a + b * b)"}
    return f"SELECT cohort, signal_0, {', '.join(f'{_r(v)} AS {n}' for n, v in cols.items())} FROM ({p})"


def _weighted(features: str) -> str:
    w = "WINDOW w AS (PARTITION BY cohort, signal_0_end)"
    df = f"SELECT *, {', '.join(f'sum({f} * peak) OVER w / sum(peak) OVER w AS state_{f}' for f in VIEWED)}, count(*) OVER w AS n FROM ({features}) {w}"
    d = f"CASE WHEN n >= 2 THEN sqrt({' + '.join(f'({f} - state_{f}) ^ 2' for f in VIEWED)}) END"
    state = ", ".join(f"CASE WHEN max(n) >= 2 THEN {_r(f'max(state_{f})')} END AS state_{f}" for f in VIEWED)
    return f"SELECT cohort, signal_0_end, CASE WHEN max(n) >= 2 THEN max(n) ELSE 0 END AS n_signals, {state}, {_r(f'avg({d})')} AS mean_distance, {_r(f'max({d})')} AS max_distance, {_r(f'stddev_pop({d})')} AS std_distance FROM ({df}) GROUP BY cohort, signal_0_end"


def _signature_sql(told: dict[str, str], engine: str) -> str:
    geo = f"SELECT *, CASE WHEN eigenvalue_2 > 0 THEN eigenvalue_1 / eigenvalue_2 END AS condition_number FROM ({told['cohort_geometry']}) WHERE engine = '{engine}'"
    own, moved, flow = ["effective_dim", "eigenvalue_1", "eigenvalue_2", "total_variance", "condition_number"], ["velocity", "acceleration", "curvature"], ["speed", "curvature", "acceleration_magnitude"]
    cols = [*own, *[f"effective_dim_{c}" for c in moved], *flow]
    j = f"SELECT g.cohort, g.signal_0_end, {', '.join(f'g.{c}' for c in own)}, {', '.join(f'd.{c} AS effective_dim_{c}' for c in moved)}, {', '.join(f'v.{c}' for c in flow)} FROM ({geo}) g JOIN (SELECT * FROM ({told['geometry_dynamics']}) WHERE engine = '{engine}') d ON g.cohort = d.cohort AND g.signal_0_end = d.signal_0_end JOIN ({told['velocity_field']}) v ON g.cohort = v.cohort AND g.signal_0_end = v.signal_0_end"
    step = " + ".join(f"(coalesce({c}, 0) - lag(coalesce({c}, 0)) OVER w) ^ 2" for c in cols)
    df = f"SELECT *, coalesce(sqrt({step}), 0) AS step FROM ({j}) WINDOW w AS (PARTITION BY cohort ORDER BY signal_0_end)"
    return _told(f"SELECT * EXCLUDE (step), sum(step) OVER (PARTITION BY cohort ORDER BY signal_0_end ROWS UNBOUNDED PRECEDING) AS arc_length FROM ({df})", "cohort, signal_0_end", [*cols, "arc_length"], DIGITS)


def _early_late(c: str) -> tuple[str, str]:
    return f"avg({c}) FILTER (i < third)", f"avg({c}) FILTER (i >= n - third)"


def _axis_sql(signature: str) -> dict[str, str]:
    """Expressions of every feature over the placed rows, by name."""
    names = [m for m in A.METRICS if m != "eigenvalue_3"]
    out = {"n_windows": "count(*)", "arc_length_total": "max(arc_length)"}
    for m in names:
        some, (early, late) = f"max(n) >= 4 AND count({m}) >= 4", _early_late(m)
        both = f"{some} AND {early} IS NOT NULL AND {late} IS NOT NULL"
        out |= {f"{m}_mean": f"avg({m})", f"{m}_std": f"stddev_pop({m})", f"{m}_min": f"min({m})", f"{m}_max": f"max({m})", f"{m}_range": f"max({m}) - min({m})"}
        out |= {f"{m}_early": f"CASE WHEN {both} THEN {early} END", f"{m}_late": f"CASE WHEN {both} THEN {late} END", f"{m}_delta": f"CASE WHEN {both} THEN {late} - {early} END", f"{m}_slope": f"CASE WHEN {some} THEN regr_slope({m}, i) END"}
        for q in (1, 2, 3):
            known = f"{m} IS NOT NULL AND pos {{}} {q / 4}"
            a = {c: f"arg_max({c}, i) FILTER ({known.format('<=')})" for c in ("pos", m)}
            b = {c: f"arg_min({c}, i) FILTER ({known.format('>')})" for c in ("pos", m)}
            out[f"{m}_q{q}"] = f"CASE WHEN count({m}) >= 3 THEN CASE WHEN {a[m]} IS NULL THEN {b[m]} WHEN {b[m]} IS NULL THEN {a[m]} ELSE {a[m]} + ({b[m]} - {a[m]}) * ({q / 4} - {a['pos']}) / ({b['pos']} - {a['pos']}) END END"
    weight = "sum(pos * pos) FILTER (curvature IS NOT NULL)"
    for m, short in A.WEIGHTED.items():
        out[f"{short}_pos_weighted"] = f"CASE WHEN {weight} > 0 THEN coalesce(sum({m} * pos * pos), 0) / {weight} END"
    enough = "max(n) >= 3 AND count(curvature) >= 3"
    out |= {"curvature_trend": f"CASE WHEN {enough} THEN regr_slope(curvature, i) END", "curvature_speed_product_late": f"CASE WHEN {enough} THEN avg(curvature * speed) FILTER (i >= n - greatest(1, third)) END"}
    return out | {"cond_spike_ratio": f"CASE WHEN max(n) >= 4 AND {_early_late('condition_number')[0]} <> 0 THEN max(condition_number) / {_early_late('condition_number')[0]} END"}


def _placed(df: str) -> str:
    return f"SELECT *, n // 3 AS third FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY signal_0_end) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM ({df}))"


def _axis(signature: str, axis: str, told: bool = True) -> str:
    df = f"SELECT *, CASE WHEN whole > 0 THEN arc_length / whole WHEN n > 1 THEN i / (n - 1) ELSE 0 END AS pos FROM (SELECT *, max(arc_length) OVER (PARTITION BY cohort) AS whole FROM ({_placed(signature)}))"
    whole = lambda c, v: v if c == "n_windows" or not told else _n(v)
    return f"SELECT cohort, {', '.join(f'{whole(c, v)} AS {axis}_{c}' for c, v in _axis_sql(signature).items())} FROM ({df}) GROUP BY cohort"


def _subwindows(told: dict[str, str]) -> str:
    geo = f"SELECT *, CASE WHEN eigenvalue_2 > 0 THEN eigenvalue_1 / eigenvalue_2 END AS condition_number FROM ({told['cohort_geometry']})"
    w = f"SELECT cohort, signal_0_end, min(effective_dim) AS eff_dim_min, max(effective_dim) - min(effective_dim) AS eff_dim_spread, max(condition_number) AS cond_max, max(condition_number) - min(condition_number) AS cond_spread, count(*) FILTER (condition_number > 100) AS degenerate, count(*) AS groups FROM ({geo}) GROUP BY cohort, signal_0_end"
    out = {"eff_dim_min_mean": "avg(eff_dim_min)", "eff_dim_min_min": "min(eff_dim_min)", "cond_max_mean": "avg(cond_max)", "cond_max_max": "max(cond_max)"}
    out |= {f"{c}_{n}": f"{f}({c})" for c in ("eff_dim_spread", "cond_spread") for n, f in (("mean", "avg"), ("max", "max"))}
    out["frac_degenerate"] = "sum(degenerate) / sum(groups)"
    for c in ("eff_dim_min", "cond_max"):
        early, late = _early_late(c)
        out |= {f"{c}_{n}": f"CASE WHEN max(n) >= 4 THEN {v} END" for n, v in (("early", early), ("late", late), ("delta", f"{late} - {early}"))}
    out |= {f"{c}_slope": f"CASE WHEN max(n) >= 4 AND count({c}) >= 3 THEN regr_slope({c}, i) END" for c in ("eff_dim_min", "eff_dim_spread")}
    return f"SELECT cohort, sum(degenerate)::BIGINT AS time_sw_n_degenerate, {', '.join(f'{_n(v)} AS time_sw_{c}' for c, v in out.items())} FROM ({_placed(w)}) GROUP BY cohort"


def _cross_sql(told: dict[str, str]) -> str:
    j = f"SELECT * FROM ({_axis(_signature_sql(told, 'shape'), 'shape', False)}) FULL JOIN ({_axis(_signature_sql(told, 'change'), 'change', False)}) USING (cohort)"
    pick = lambda c: f"[x for x in [shape_{c}, change_{c}] if x IS NOT NULL]"
    df = f"SELECT cohort, {pick('effective_dim_delta')} AS d, {pick('condition_number_late')} AS c, {pick('effective_dim_late')} AS e FROM ({j})"
    down = "len([x for x in d if x < -0.15])"
    out = {"min_dim_delta": "list_min(d)", "max_dim_delta": "list_max(d)", "mean_dim_delta": "list_avg(d)", "dim_delta_spread": "list_max(d) - list_min(d)"}
    for c, n, end in (("c", "cond_late", "max"), ("e", "dim_late", "min")):
        out |= {f"{n}_{k}": f"CASE WHEN len({c}) >= 2 THEN {v} END" for k, v in (("mean", f"list_avg({c})"), (end, f"list_{end}({c})"), ("std", f"list_stddev_pop({c})"))}
    return f"SELECT cohort, {down} AS cross_n_axes_collapsing, ({down} > 0)::INT AS cross_collapse_on_any, ({down} = 2)::INT AS cross_collapse_on_all, {', '.join(f'{_n(v)} AS cross_{c}' for c, v in out.items())} FROM ({df})"


def oracle(features: str, events: str, told: dict[str, str]) -> dict[str, str]:
    """features: SQL of the line item windows; events: of the event windows; told: the other queries' SQL."""
    rounded_rms = f"SELECT cohort, signal_id, signal_0_end, {_r('rms')} AS rms FROM ({events})"
    place = f"SELECT *, row_number() OVER (PARTITION BY cohort, signal_id ORDER BY signal_0_end) - 1 AS i FROM ({rounded_rms})"
    return {
        "interpolated": _interpolated(),
        "rolling_departures": _departures(),
        "rolling_statistics": _rolling(events, {"kurtosis": "kurtosis", "skewness": "skewness", "crest_factor": "crest_factor"}),
        "rolling_trend": _rolling(events, {"trend_slope": "trend_slope", "trend_r2": "trend_r2", "detrend_std": "std * sqrt(1 - trend_r2)"}),
        "window_changes": _changes(),
        "window_trend": f"SELECT cohort, signal_id, CASE WHEN count(rms) >= 4 THEN {_r('regr_slope(rms, i)')} END AS rms_slope, CASE WHEN count(rms) >= 4 THEN {_r('CASE WHEN var_pop(rms) > 0 THEN regr_r2(rms, i) ELSE 0 END')} END AS rms_r2 FROM ({place}) GROUP BY cohort, signal_id",
        "active_signals": "SELECT cohort, signal_id, count(*) AS n FROM (SELECT p_brand AS cohort, 'retailprice' AS signal_id, p_retailprice AS value FROM part UNION ALL SELECT p_brand, 'size', p_size FROM part) GROUP BY cohort, signal_id HAVING signal_id IN (SELECT 'retailprice' FROM part HAVING stddev_pop(p_retailprice) >= 1e-10 UNION ALL SELECT 'size' FROM part HAVING stddev_pop(p_size) >= 1e-10)",
        "weighted_centroid": _weighted(features),
        "sensor_eigen": _sensors(),
        "segment_comparison": _segments(),
        "baseline_spectrum": _base(),
        "baseline_scores": _scores(),
        "trajectory_signatures": _signature_sql(told, "change"),
        "axis_features": _axis(_signature_sql(told, "change"), "time"),
        "subwindow_features": _subwindows(told),
        "cross_axis_features": _cross_sql(told),
    }
