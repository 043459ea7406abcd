"""Operators whose state runs through a whole series or pair: one Arrow group for each, on kernels of functions.series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from .curves import curve_features
from .windows import SERIES, assigned, gradient, guarded, ordered, r_squared, tail


#: Rows of a part of a series.
PART = 8192


def _series(obs: DataFrame, of, schema: str, keys: list[str] = SERIES) -> DataFrame:
    """of(values, coordinates) -> rows (dicts) for each series, in order of the coordinate."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signal_0", kind="stable")
        with np.errstate(all="ignore"):
            rows = of(pdf["value"].to_numpy(float), pdf["signal_0"].to_numpy(float))
        return pd.DataFrame([{**dict(zip(keys, key)), **r} for r in rows], columns=[*keys, *names])

    return obs.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + schema)


def breaks(obs: DataFrame, sensitivity: float = 1.0, spacing: int = 10, context: int = 50) -> DataFrame:
    def of(y, t):
        return [{"signal_0": t[b.pop("index")], **b} for b in s.breaks(y, sensitivity, spacing, context)]

    return _series(obs, of, "signal_0 double, kind string, magnitude double, direction int, sharpness double, duration int, pre_level double, post_level double, snr double, score double")


def summarize_breaks(found: DataFrame) -> DataFrame:
    m = F.abs("magnitude")
    return found.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_breaks"), guarded(F.max("signal_0") - F.min("signal_0"), F.count(F.lit(1)) - 1).alias("mean_spacing"), F.avg(m).alias("mean_magnitude"), F.max(m).alias("max_magnitude"), F.avg("sharpness").alias("mean_sharpness"), F.max("sharpness").alias("max_sharpness"))


_FTLE = "ftle double, embedding_dim int, embedding_tau int, confidence double, n_samples int, stability string, direction string"


def ftle(obs: DataFrame, least: int = 200, method: str = "rosenstein", direction: str = "forward", cap: int = 2000) -> DataFrame:
    """Largest exponent of each series; backward reads it in reverse (and so its head, where it is long)."""

    def of(y, _):
        r = s.ftle(y[::-1] if direction == "backward" else y, least, method, cap)
        return [{**r, "stability": s.stability(r["ftle"]), "direction": direction}]

    return _series(obs if direction == "backward" else tail(obs, cap), of, _FTLE)


def ftle_both(obs: DataFrame, **options) -> DataFrame:
    return ftle(obs, direction="forward", **options).unionByName(ftle(obs, direction="backward", **options))


def ftle_around(obs: DataFrame, event: float, least: int = 50) -> DataFrame:
    """Exponents before and after an event, and their difference."""
    parts = [ftle(obs.where(c), least).select(*SERIES, F.col("ftle").alias(n)) for c, n in ((F.col("signal_0") < event, "ftle_pre"), (F.col("signal_0") >= event, "ftle_post"))]
    return parts[0].join(parts[1], SERIES, "full").withColumn("ftle_delta", F.col("ftle_post") - F.col("ftle_pre"))


def ftle_rolling(obs: DataFrame, width: int = 200, stride: int = 50) -> DataFrame:
    """Exponents of hopping windows, and their first and second differences."""

    def of(y, t):
        y = s.interpolate(y)
        if len(y) < width:
            return []
        tau = min(s.k.optimal_delay(y[:width]), max(1, width // 20))
        dim = max(2, s.k.optimal_dimension(y[:width], tau))
        return [{"signal_0_end": t[e], "ftle": s.k.rosenstein(y[e + 1 - width : e + 1], dim, tau)[0]} for e in range(width - 1, len(y), stride)]

    made = _series(obs, of, "signal_0_end double, ftle double")
    w = Window.partitionBy(*SERIES).orderBy("signal_0_end")
    v = made.withColumn("ftle_velocity", F.coalesce(F.col("ftle") - F.lag("ftle").over(w), F.lit(0.0)))
    return v.withColumn("ftle_acceleration", F.coalesce(F.col("ftle_velocity") - F.lag("ftle_velocity").over(w), F.lit(0.0)))


def ridge_proximity(rolling: DataFrame, field: DataFrame, ridge: float = 0.05, urgent: float = 0.001) -> DataFrame:
    """Speed times the gradient of the exponent where both are known: how soon a ridge is met, and how urgent that is.

    Cohorts with under three common coordinates and series with under three rows have no result; time_to_ridge is infinite
    where nothing approaches."""
    w = Window.partitionBy(*SERIES).orderBy("signal_0_end")
    g = rolling.withColumns({"ftle_gradient": gradient(F.col("ftle"), F.col("signal_0_end"), w), "__n": F.count(F.lit(1)).over(Window.partitionBy(*SERIES))})
    inner = F.lead("signal_0_end").over(w).isNotNull() & F.lag("signal_0_end").over(w).isNotNull()
    g = g.withColumn("ftle_acceleration", F.when(inner, F.col("ftle_gradient") - F.lag("ftle_gradient").over(w)).otherwise(0.0)).where(F.col("__n") >= 3).drop("__n")
    j = g.join(field.select("cohort", "signal_0_end", "speed"), ["cohort", "signal_0_end"])
    keys = j.groupBy("cohort").agg(F.count_distinct("signal_0_end").alias("k")).where("k >= 3").select("cohort")  # a row for each cohort
    j = j.join(keys, "cohort", "left_semi").withColumn("urgency", F.col("speed") * F.col("ftle_gradient"))
    near = (F.col("urgency") > urgent) & (F.abs("ftle_gradient") > 1e-6)
    left = F.greatest(F.lit(0.0), ridge - F.col("ftle")) / (F.abs("urgency") + 1e-12)
    high, coming = F.col("ftle") > ridge, F.col("urgency") > urgent
    kind = F.when(high & coming, "critical").when(high, "elevated").when(coming, "warning").otherwise("nominal")
    return j.withColumns({"time_to_ridge": F.when(near, left).otherwise(float("inf")), "urgency_class": kind})


def slowing_down(obs: DataFrame, window: int = 50, step: int = 10) -> DataFrame:
    """Critical slowing down of each detrended series: lag-1 autocorrelation, variance and skewness of hopping windows, their trends
    and a score. Null values are left out; series under two windows have no measures and score 0. Aggregates only: the line
    through the whole series, then one row for each window."""
    series = Window.partitionBy(*SERIES)
    ok = obs.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = assigned(ok, window, step).where(F.col("n") >= 2 * window)
    line = ok.withColumn("__i", F.row_number().over(ordered()) - 1).groupBy(*SERIES).agg(F.regr_slope("value", "__i").alias("__slope"), F.regr_intercept("value", "__i").alias("__cut"))
    r = rows.join(line, SERIES).withColumn("r", F.col("value") - F.col("__cut") - F.col("__slope") * F.col("rn"))
    one = Window.partitionBy(*SERIES, "window_id")
    r = r.withColumn("e", F.col("r") - F.avg("r").over(one)).withColumn("f", F.lag("e").over(one.orderBy("rn")))
    made = r.groupBy(*SERIES, "window_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("e") * F.col("f")).alias("up"), F.sum(F.col("e") ** 2).alias("ee"), F.avg(F.col("e") ** 3).alias("m3")).where(F.col("k") == window)
    var = F.col("ee") / window
    made = made.withColumns({"ac": guarded(F.col("up"), F.col("ee"), 1e-10), "var": var, "skew": F.when(F.sqrt(var) < 1e-10, 0.0).otherwise(F.col("m3") / F.pow(F.when(var > 0, F.sqrt(var)), 3)), "last": F.max("window_id").over(series)})
    at = F.col("window_id").cast("double")
    end = lambda c: F.max(F.when(F.col("window_id") == F.col("last"), F.col(c)))
    base = F.max(F.when(F.col("window_id") == 0, F.col("var")))
    r2 = lambda c: r_squared(F.col(c), F.when(F.col(c).isNotNull(), at))
    g = made.groupBy(*SERIES).agg(end("ac").alias("autocorrelation_lag1"), end("var").alias("variance"), end("skew").alias("skewness"), F.regr_slope(F.col("ac"), at).alias("autocorr_trend"), r2("ac").alias("autocorr_trend_r2"), F.regr_slope(F.col("var"), at).alias("variance_trend"), r2("var").alias("variance_trend_r2"), F.when(base > 0, end("var") / F.when(base > 0, base)).alias("variance_ratio"))
    part = lambda c, weight: (F.coalesce(weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), F.lit(0.0)), F.when(c.isNotNull(), weight).otherwise(0.0))
    parts = [part(F.col("autocorrelation_lag1"), 0.3), part(F.col("autocorr_trend") * 10, 0.25), part(F.col("variance_trend") * 100, 0.25), part((F.coalesce("variance_ratio", F.lit(1.0)) - 1) / 2, 0.2)]
    score, weight = (sum((x[i] for x in parts), F.lit(0.0)) for i in (0, 1))
    ac = F.col("autocorrelation_lag1")
    g = g.withColumns({"recovery_rate": F.when((ac > 0) & (ac < 1), -F.ln(F.when(ac > 0, ac))), "csd_score": score / weight})
    g = g.withColumn("csd_detected", F.coalesce((F.col("csd_score") > 0.6) & (ac > 0.7) & (F.col("variance_trend") > 0), F.lit(False)))
    every = obs.select(*SERIES).distinct().join(g, SERIES, "left")
    return every.withColumns({"csd_score": F.coalesce("csd_score", F.lit(0.0)), "csd_detected": F.coalesce("csd_detected", F.lit(False))})


def fingerprint_windows(obs: DataFrame, width: int = 50, stride: int = 24) -> DataFrame:
    """cohort, signal_0_end and 18 metrics of each hopping window of a cohort's z-scored signals (18 columns of METRICS)."""
    series = Window.partitionBy(*SERIES)
    m, sd = F.avg("value").over(series), F.stddev_pop("value").over(series)
    z = obs.withColumn("value", F.when(sd > 1e-10, guarded(F.col("value") - m, sd, 1e-10)).otherwise(F.col("value") - m))
    rows = assigned(z, width, stride)
    packed = rows.groupBy("cohort", "window_id", "signal_id").agg(F.count(F.lit(1)).alias("k"), F.max("signal_0").alias("signal_0_end"), F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("x")).where(F.col("k") == width)
    packed = packed.groupBy("cohort", "window_id").agg(F.max("signal_0_end").alias("signal_0_end"), F.array_sort(F.collect_list(F.struct("signal_id", F.col("x.value").alias("x")))).alias("x"))

    def run(batches):
        for pdf in batches:
            with np.errstate(all="ignore"):
                made = [{"cohort": r.cohort, "signal_0_end": r.signal_0_end, **s.window_metrics(np.array([[np.nan if v is None else v for v in y["x"]] for y in r.x], float))} for r in pdf.itertuples()]
            yield pd.DataFrame(made, columns=["cohort", "signal_0_end", *s.METRICS])

    # a window's signals of one cohort: a small matrix each, many of them a batch
    return packed.select("cohort", "signal_0_end", "x").mapInPandas(run, "cohort string, signal_0_end double, " + ", ".join(f"{c} double" for c in s.METRICS))


def fingerprint(obs: DataFrame, width: int = 50, stride: int = 24) -> DataFrame:
    """A row of 450 numbers for each cohort: the 25 curve features of each of the 18 window metrics."""
    return curve_features(fingerprint_windows(obs, width, stride), ["cohort"], "signal_0_end", s.METRICS)


def saddles(obs: DataFrame) -> DataFrame:
    return _series(tail(obs, 400), lambda y, _: [s.saddles(y)], "max_saddle_score double, mean_saddle_score double, n_saddles int, basin_stability double")


def attractors(obs: DataFrame, cap: int = 500) -> DataFrame:
    """Delay, dimension and recurrence measures of the reconstructed attractor."""

    def of(y, _):
        y = y[np.isfinite(y)]
        if len(y) < 100 or y.std() < 1e-12:
            return []
        tau = s.k.optimal_delay(y)
        dim = max(2, s.k.optimal_dimension(y, tau))
        return [{"delay": tau, "dimension": dim, "correlation_dim": s.k.correlation_dimension(y, dim, tau), **s.k.recurrence(s.k.embed(y, dim, tau))}]

    return _series(tail(obs, cap), of, "delay int, dimension int, correlation_dim double, recurrence_rate double, determinism double, laminarity double, diagonal_entropy double, trapping_time double")


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Rows by coordinate, columns by signal, gaps interpolated."""
    wide = pdf.pivot_table(index="signal_0", columns="signal_id", values="value", aggfunc="first").sort_index()
    return np.column_stack([s.interpolate(wide[c].to_numpy(float)) for c in wide]), list(wide), wide.index.to_numpy(float)


def _cohorts(obs: DataFrame, of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            rows = of(*_matrix(pdf))
        return pd.DataFrame([{"cohort": key[0], **r} for r in rows], columns=["cohort", *names])

    return obs.groupBy("cohort").applyInPandas(run, "cohort string, " + schema)


def sensitivities(obs: DataFrame, cap: int = 400) -> DataFrame:
    """Which signals' small differences grow fastest."""

    def of(m, names, _):
        v = s.sensitivity(m)
        order = np.argsort(np.argsort(-v))
        return [{"signal_id": n, "sensitivity": x, "rank": int(r) + 1} for n, x, r in zip(names, v, order)]

    return _cohorts(tail(obs, cap), of, "signal_id string, sensitivity double, rank int")


#: Windows of a range of a cohort (so many times the stride coordinates), and ranges whose last windows meet.
WINDOWS, MEET = 128, 16
_HOMOLOGY = "signal_0_end double, n_components int, n_loops int, max_persistence_h0 double, max_persistence_h1 double, persistence_entropy double"


def _blocks(obs: DataFrame, size: int) -> DataFrame:
    """cohort, range (of so many coordinates), signal_id, t, v: numbers in blocks, packed before they move. Nulls are dropped."""

    def pack(batches):
        for batch in batches:
            cohort, signal = (batch.column(c).dictionary_encode() for c in ("cohort", "signal_id"))
            c, g = (np.asarray(x.indices.fill_null(-1)) for x in (cohort, signal))
            t, v = np.asarray(batch.column("signal_0"), float), np.asarray(batch.column("value"), float)
            held = np.flatnonzero((v == v) & (t == t) & (g >= 0))
            r = np.floor(t[held] / size).astype(np.int64)
            turn = np.lexsort((r, g[held], c[held]))
            held, r = held[turn], r[turn]
            first = np.flatnonzero(np.r_[True, (np.diff(r) != 0) | (np.diff(g[held]) != 0) | (np.diff(c[held]) != 0)][: len(held)])
            ends = pa.array(np.r_[first, len(held)], pa.int32())
            row = pa.array(held[first])
            columns = [batch.column("cohort").take(row), pa.array(r[first]), batch.column("signal_id").take(row), *[pa.ListArray.from_arrays(ends, pa.array(x[held])) for x in (t, v)]]
            yield pa.RecordBatch.from_arrays(columns, ["cohort", "range", "signal_id", "t", "v"])

    return obs.select("cohort", "signal_id", F.col("signal_0").cast("double"), F.col("value").cast("double")).mapInArrow(pack, "cohort string, range long, signal_id string, t array<double>, v array<double>")


def _side_by_side(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Coordinates of a range, and each signal's numbers there; of rows that share a coordinate the first one."""
    t, cols = np.unique(np.concatenate(list(pdf["t"]))), {}
    for name, own in pdf.groupby("signal_id"):
        v, at = np.full(len(t), np.nan), np.searchsorted(t, np.concatenate(list(own["t"])))
        v[at[::-1]] = np.concatenate(list(own["v"]))[::-1]
        cols[name] = v
    return t, cols


_NEAR = "cohort string, range long, at long, names array<string>, mean array<double>, sd array<double>, near array<array<double>>"


def _told(dealt: DataFrame) -> DataFrame:
    """By range: at (the place of its first row), the cohort's signals with mean and spread of the filled series, and near: for each
    signal place and number of the nearest value before the range and after it.

    Ranges tell size, ends and moments only; what lies between two ranges' numbers is on a line, whose moments follow from its ends."""

    def tell(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t, cols = _side_by_side(pdf)
        out = []
        for name, v in cols.items():
            at, row = np.flatnonzero(np.isfinite(v)), [0.0] * 7
            if len(at):
                x = np.interp(np.arange(at[0], at[-1] + 1), at, v[at])
                row = [at[0], v[at[0]], at[-1], v[at[-1]], len(x), x.mean(), ((x - x.mean()) ** 2).sum()]
            out.append((*key, len(t), name, [float(e) for e in row]))
        return pd.DataFrame(out, columns=["cohort", "range", "m", "signal_id", "of"])

    def place(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf.groupby("range")["m"].first().sort_index()
        ranges, after = size.index.to_numpy(), size.to_numpy().cumsum()
        before, total, names = after - size.to_numpy(), int(after[-1]), sorted(set(pdf["signal_id"]))
        near, scale = [], []
        for _, own in pdf[["signal_id", "range", "of"]].groupby("signal_id"):
            of, i = np.array(own["of"].tolist(), float), np.searchsorted(ranges, own["range"])
            some = of[:, 4] > 0
            if not some.any():
                near.append(np.full((len(ranges), 4), np.nan))
                scale.append((0.0, 1e-12))
                continue
            turn = np.argsort(i[some])
            of, i = of[some][turn], i[some][turn]
            p0, v0, p1, v1 = of[:, 0] + before[i], of[:, 1], of[:, 2] + before[i], of[:, 3]
            gap, step = p0[1:] - p1[:-1] - 1, v0[1:] - v1[:-1]
            n = np.r_[of[:, 4], gap, p0[0], total - 1 - p1[-1]]
            mean = np.r_[of[:, 5], (v1[:-1] + v0[1:]) / 2, v0[0], v1[-1]]
            m2 = np.r_[of[:, 6], (step / (gap + 1)) ** 2 * gap * (gap**2 - 1) / 12, 0, 0]
            middle = (n * mean).sum() / total
            scale.append((middle, max(np.sqrt((m2 + n * (mean - middle) ** 2).sum() / total), 1e-12)))
            old, new = np.searchsorted(i, np.arange(len(ranges))) - 1, np.searchsorted(i, np.arange(len(ranges)), "right")
            pick = lambda x, k: np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, len(x) - 1)], np.nan)
            near.append(np.column_stack([pick(p1, old), pick(v1, old), pick(p0, new), pick(v0, new)]))
        mean, sd = ([float(x) for x in xs] for xs in zip(*scale))
        return pd.DataFrame([(key[0], int(r), int(a), names, mean, sd, [n[k].tolist() for n in near]) for k, (r, a) in enumerate(zip(ranges, before))], columns=[c.split()[0] for c in _NEAR.split(", ")])

    told = dealt.groupBy("cohort", "range").applyInPandas(tell, "cohort string, range long, m long, signal_id string, of array<double>")
    return told.groupBy("cohort").applyInPandas(place, _NEAR)


def homology(obs: DataFrame, window: int = 60, stride: int = 30) -> DataFrame:
    """Rips lifetimes of each window of a cohort's standardised signals.

    Ranges of WINDOWS * stride coordinates, not whole cohorts, are in a task; windows that lie in one range are computed there, and only
    the rows of the others move once more. The numbers move once, in blocks, and are read twice: for what ranges tell, and for windows."""
    names = [c.split()[0] for c in _HOMOLOGY.split(", ")]
    n, schema = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"cohort string, part long, start long, at long, t array<double>, x array<double>, {_HOMOLOGY}"
    # few bytes and much work: by number, so that small parts are not put together in few tasks
    dealt = _blocks(obs, WINDOWS * stride).repartition(n, "cohort", "range")

    def walk(cohort, z, t) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            return pd.DataFrame({"cohort": cohort, "signal_0_end": t, **s.homologies(z)})

    def of(key, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        (t, cols), r = _side_by_side(pdf), told.iloc[0]
        m, at, filled = len(t), int(r["at"]), []
        for name, near in zip(r["names"], (np.array(x, float) for x in r["near"])):
            v = cols.get(name, np.full(m, np.nan))
            own = np.flatnonzero(np.isfinite(v))
            places, numbers = np.r_[near[0] - at, own, near[2] - at], np.r_[near[1], v[own], near[3]]
            known = np.isfinite(places)
            filled.append(np.interp(np.arange(m), places[known], numbers[known]) if known.any() else np.zeros(m))
        z = (np.column_stack(filled) - np.asarray(r["mean"], float)) / np.asarray(r["sd"], float)
        low, high = -(-at // stride), (at + m - window) // stride  # of whole windows, by number
        out = []
        if low <= high:
            inside = np.lib.stride_tricks.sliding_window_view(z, window, 0)[low * stride - at :: stride][: high - low + 1].swapaxes(1, 2)
            out.append(walk(key[0], inside, t[low * stride - at + window - 1 :: stride][: high - low + 1]).assign(part=np.arange(low, high + 1) // (WINDOWS * MEET)))
        cut = []
        for k in range(max(0, (at - window) // stride + 1), (at + m - 1) // stride + 1):
            if not low <= k <= high:
                a, b = max(k * stride - at, 0), min(k * stride + window - at, m)
                cut.append((key[0], k // (WINDOWS * MEET), k * stride, at + a, t[a:b], z[a:b].ravel()))
        out.append(pd.DataFrame(cut, columns=["cohort", "part", "start", "at", "t", "x"]))
        out = pd.concat(out).reindex(columns=[c.split()[0] for c in schema.split(", ")])
        return out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in ("t", "x")})

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out, cut = [pdf.loc[pdf["start"].isna(), ["cohort", *names]]], pdf[pdf["start"].notna()]
        ends, whole = [], []
        for _, one in cut.groupby("start"):
            one = one.sort_values("at")
            t = np.concatenate(list(one["t"]))
            if len(t) == window:  # else the cohort ends before
                ends.append(t[-1])
                whole.append(np.concatenate(list(one["x"])).reshape(window, -1))
        if whole:
            out.append(walk(key[0], np.stack(whole), np.array(ends)))
        return pd.concat(out)

    told = _told(dealt).repartition(n, "cohort", "range")
    parts = dealt.groupBy("cohort", "range").cogroup(told.groupBy("cohort", "range")).applyInPandas(of, schema)
    return parts.groupBy("cohort", "part").applyInPandas(join, "cohort string, " + _HOMOLOGY)


_PAIR = "n int, correlation double, max_xcorr double, lag_at_max int, xcorr_symmetry double, mutual_info double, normalized_mi double, transfer_entropy_ab double, transfer_entropy_ba double, granger_f_ab double, granger_p_ab double, granger_f_ba double, granger_p_ba double, coint_stat double, cointegrated boolean, half_life double, spread_z double, hedge_ratio double, copula string, copula_param double, copula_aic double, kendall_tau double, spearman_rho double, tail_lower double, tail_upper double, empirical_tail_lower double, empirical_tail_upper double, dtw double, kl_divergence double, js_divergence double"


def information_flow(obs: DataFrame, pairs: DataFrame | None = None, least: int = 100, cap: int | None = 2000) -> DataFrame:
    """Dependence of each pair of signals of a cohort (or of the given pairs: cohort, signal_a, signal_b).

    Series are cut to their newest rows first, so a pair's group has a fixed size (cap None: whole series); pairs are spread by their own key."""
    recent = (obs if cap is None else tail(obs, cap)).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("signal_0", "value"))).alias("xs"))
    a = recent.select("cohort", F.col("signal_id").alias("signal_a"), F.col("xs.value").alias("x"))
    b = recent.select("cohort", F.col("signal_id").alias("signal_b"), F.col("xs.value").alias("y"))
    both = a.join(b, "cohort").where("signal_a < signal_b")
    if pairs is not None:
        both = both.join(pairs.select("cohort", "signal_a", "signal_b").distinct(), ["cohort", "signal_a", "signal_b"], "left_semi")
    names = [c.split()[0] for c in _PAIR.split(", ")]

    def run(batches):
        for pdf in batches:
            with np.errstate(all="ignore"):
                rows = [(r, s.pair(np.array(r.x, float), np.array(r.y, float), least, cap)) for r in pdf.itertuples()]
            yield pd.DataFrame([{"cohort": r.cohort, "signal_a": r.signal_a, "signal_b": r.signal_b, **m} for r, m in rows if m], columns=["cohort", "signal_a", "signal_b", *names])

    spread = both.repartition("cohort", "signal_a", "signal_b")
    return spread.mapInPandas(run, "cohort string, signal_a string, signal_b string, " + _PAIR)


#: Parts that are stacked at a time.
STACK = 512
_GRANGER = "granger_f_ab double, granger_p_ab double, granger_f_ba double, granger_p_ba double"
_TRIANGLE = "n long, mean_a double, m2_a double, mean_b double, m2_b double, ab array<double>, ba array<double>"


def _backwards(obs: DataFrame, lag: int) -> DataFrame:
    """cohort, part, signal_id, start, v: the numbers of each series, the newest first, by parts of PART places and the lag older ones.

    Rows are packed by ranges of the coordinate; the packs' sizes, a row for each, say at which place a pack starts."""
    ok = obs.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    pack = F.sort_array(F.collect_list(F.struct(F.negate("signal_0").alias("t"), "value")))
    packed = ok.groupBy(*SERIES, F.floor(F.col("signal_0") / PART).alias("range")).agg(pack.alias("xs")).select(*SERIES, "range", F.col("xs.value").alias("v"))
    newer = Window.partitionBy(*SERIES).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = packed.select(*SERIES, "range", F.size("v").cast("long").alias("m"))
    sizes = sizes.withColumn("at", F.coalesce(F.sum("m").over(newer), F.lit(0).cast("long")))
    placed = packed.join(sizes, [*SERIES, "range"])
    first, last = F.greatest(F.floor((F.col("at") - lag) / PART), F.lit(0)), F.floor((F.col("at") + F.col("m") - 1) / PART)
    cut = placed.withColumn("part", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("part") * PART, F.col("at")), F.least((F.col("part") + 1) * PART + lag, F.col("at") + F.col("m"))
    cut = cut.withColumns({"start": low, "k": high - low})
    return cut.select("cohort", "part", "signal_id", "start", F.slice("v", (F.col("start") - F.col("at") + 1).cast("int"), F.col("k").cast("int")).alias("v"))


def granger_links(obs: DataFrame, least: int = 100, lag: int = 5) -> DataFrame:
    """The Granger measures of information_flow, of whole series of any length: cohort, signal_a, signal_b and four numbers.

    Series are paired by place from their newest number. Each part of a pair is reduced to the triangle (QR) of its regressions;
    triangles stacked and reduced again have the sums of squares of the whole, so no task holds a series."""
    width, keys = 2 * lag + 2, ["cohort", "signal_a", "signal_b"]
    names = [c.split()[0] for c in _TRIANGLE.split(", ")]
    key_schema = ", ".join(f"{k} string" for k in keys)

    def triangles(key, pdf: pd.DataFrame) -> pd.DataFrame:
        xs = {name: np.concatenate(list(g.sort_values("start")["v"]))[::-1].astype(float) for name, g in pdf.groupby("signal_id")}
        out, signals = [], sorted(xs)
        for i, a in enumerate(signals):
            for b in signals[i + 1 :]:
                n = min(len(xs[a]), len(xs[b]))
                x, y = xs[a][-n:], xs[b][-n:]
                r = []
                for u, v in ((x, y), (y, x)):  # the target's own past, then the other's, then the target
                    past = [c[lag - j : n - j] for c in (v, u) for j in range(1, lag + 1)]
                    r.append(np.linalg.qr(np.column_stack([np.ones(n - lag), *past, v[lag:]]), "r").ravel() if n > lag else np.zeros(0))
                x, y = x[-PART:], y[-PART:]
                out.append((key[0], a, b, key[1] // STACK, len(x), x.mean(), ((x - x.mean()) ** 2).sum(), y.mean(), ((y - y.mean()) ** 2).sum(), *r))
        return pd.DataFrame(out, columns=[*keys, "stack", *names])

    def whole(pdf: pd.DataFrame) -> list:
        """Sizes, means and squares about the mean of all parts, and the triangle of each way."""
        n, out = pdf["n"].sum(), []
        for s_ in "ab":
            mean = (pdf["n"] * pdf[f"mean_{s_}"]).sum() / n
            out += [mean, (pdf[f"m2_{s_}"] + pdf["n"] * (pdf[f"mean_{s_}"] - mean) ** 2).sum()]
        return [n, *out, *[np.linalg.qr(np.concatenate([np.zeros((1, width)), *[np.reshape(r, (-1, width)) for r in pdf[way]]]), "r") for way in ("ab", "ba")]]

    def stacked(key, pdf: pd.DataFrame) -> pd.DataFrame:
        *told, ab, ba = whole(pdf)
        return pd.DataFrame([(*key[:3], *told, ab.ravel(), ba.ravel())], columns=[*keys, *names])

    def solved(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n, _, qa, _, qb, *both = whole(pdf)
        out = [s.granger_of(r, n, lag) if n >= 25 and min(qa, qb) >= n * 1e-24 else (np.nan, np.nan) for r in both]
        return pd.DataFrame([(*key, *out[0], *out[1])] if n >= least else [], columns=[*keys, *[c.split()[0] for c in _GRANGER.split(", ")]])

    made = _backwards(obs, lag).groupBy("cohort", "part").applyInPandas(triangles, f"{key_schema}, stack long, {_TRIANGLE}")
    some = made.groupBy(*keys, "stack").applyInPandas(stacked, f"{key_schema}, {_TRIANGLE}")
    return some.groupBy(*keys).applyInPandas(solved, f"{key_schema}, {_GRANGER}")


def flow_delta(before: DataFrame, after: DataFrame, p: float = 0.05) -> DataFrame:
    """How each directed link (Granger) changed between two segments."""
    keys = ["cohort", "signal_a", "signal_b"]

    def links(df: DataFrame, tag: str) -> DataFrame:
        two = df.select(*keys, F.explode(F.array(F.struct(F.lit("ab").alias("way"), F.col("granger_f_ab").alias("f"), F.col("granger_p_ab").alias("p")), F.struct(F.lit("ba").alias("way"), F.col("granger_f_ba").alias("f"), F.col("granger_p_ba").alias("p")))).alias("x"))
        return two.select(*keys, "x.way", F.col("x.f").alias(f"f_{tag}"), (F.col("x.p") < p).alias(f"sig_{tag}"))

    j = links(before, "a").join(links(after, "b"), [*keys, "way"], "full")
    sa, sb, ratio = F.coalesce("sig_a", F.lit(False)), F.coalesce("sig_b", F.lit(False)), guarded(F.col("f_b"), F.col("f_a"), 1e-12)
    return j.withColumn("change", F.when(sb & ~sa, "emerged").when(sa & ~sb, "dissolved").when(~sa & ~sb, "absent").when(ratio > 1.5, "strengthened").when(ratio < 0.67, "weakened").otherwise("stable"))


def trajectory_library(df: DataFrame, order: str, values: list[str], points: int = 50, most: int = 20) -> DataFrame:
    """Cohorts clustered by warped distance of their resampled, scaled trajectories; the number of clusters by silhouette.

    One row for each cohort, so the distance matrix has cohorts x cohorts entries and lives in one task: a fleet, not a corpus."""
    arrays = df.groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("xs"))
    sized = arrays.select("cohort", F.lit(1).alias("one"), *[F.col(f"xs.{v}").alias(v) for v in values])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cohort").reset_index(drop=True)
        grid = np.linspace(0, 1, points)
        t = np.stack([np.stack([np.interp(grid, np.linspace(0, 1, len(x)), s.interpolate(np.array(x, float))) for x in pdf[v]]) for v in values], 2)
        t = (t - t.mean((0, 1))) / np.maximum(t.std((0, 1)), 1e-12)
        n = len(t)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                d[i, j] = d[j, i] = np.mean([s.dtw(t[i, :, c], t[j, :, c]) for c in range(t.shape[2])]) / points
        options = [(s.silhouette(d, label), -c, label) for c in range(2, min(most, n - 1) + 1) for label in [s.ward(d, c)]]
        label = max(options, key=lambda o: o[:2])[2] if options else np.zeros(n, int)
        medoid = {c: np.flatnonzero(label == c)[d[np.ix_(label == c, label == c)].sum(1).argmin()] for c in np.unique(label)}
        out = []
        for i in range(n):
            near = sorted((d[i, m], c) for c, m in medoid.items())
            second = near[1][0] if len(near) > 1 else np.nan
            out.append((pdf["cohort"][i], int(label[i]), pdf["cohort"][medoid[label[i]]], float(near[0][0]), second, 1 - near[0][0] / second if second and second == second else np.nan))
        return pd.DataFrame(out, columns=["cohort", "trajectory_id", "medoid", "match_distance", "second_distance", "match_confidence"])

    return sized.groupBy("one").applyInPandas(run, "cohort string, trajectory_id int, medoid string, match_distance double, second_distance double, match_confidence double")
