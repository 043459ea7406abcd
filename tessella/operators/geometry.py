"""Geometry of a cohort's signals in feature space, window by window, and its change over windows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import gradient, guarded

AT = ["cohort", "signal_0_end"]
#: Feature groups of the window table; the complete rows of each span one geometry.
GROUPS = {"shape": ["kurtosis", "skewness", "crest_factor"], "change": ["rms", "trend_r2", "rate_std"]}


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def centroid(windows: DataFrame, features: list[str], keys: list[str] = AT) -> DataFrame:
    """Mean of each feature over the signals of a window; mean, largest and population spread of the signals' distances."""
    w = Window.partitionBy(*keys)  # the signals of one cohort at one window: few rows
    mean = {f"state_{f}": F.avg(_finite(f)).over(w) for f in features}
    df = windows.withColumns(mean)
    full = reduce(Column.__and__, [_finite(f).isNotNull() for f in features])
    d = F.sqrt(reduce(Column.__add__, [(F.col(f) - F.col(f"state_{f}")) ** 2 for f in features]))
    df = df.withColumn("__d", F.when(full, d))
    stats = [F.count(F.lit(1)).alias("n_signals"), F.avg("__d").alias("mean_distance"), F.max("__d").alias("max_distance"), F.stddev_pop("__d").alias("std_distance")]
    return df.groupBy(*keys).agg(*stats, *[F.max(f"state_{f}").alias(f"state_{f}") for f in features])


def _t_quantile(n: int) -> float:
    """97.5 % quantile of Student's t by Cornish-Fisher expansion."""
    z, v = 1.959963984540054, max(n, 1)
    return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)


def eigen(matrix: np.ndarray) -> dict | None:
    """Covariance spectrum of z-scored columns; None with under two rows or a constant column."""
    m = matrix[np.isfinite(matrix).all(1)]
    if len(m) < 2 or (m.std(0) < 1e-10).any():
        return None
    z = (m - m.mean(0)) / m.std(0)
    val, vec = np.linalg.eigh(np.cov(z.T, ddof=1).reshape(m.shape[1], -1))
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 0), vec[:, order]
    total, p = val.sum(), val / max(val.sum(), 1e-300)
    dim = lambda v: v.sum() ** 2 / max((v**2).sum(), 1e-300)
    h = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    jack = []
    if 3 <= len(m) <= 64:  # all leave-one-out covariances at once
        n = len(m)
        rest = np.broadcast_to(m, (n, *m.shape))[~np.eye(n, dtype=bool)].reshape(n, n - 1, -1)
        rest = rest - rest.mean(1, keepdims=True)
        spectra = np.maximum(np.linalg.eigvalsh(np.einsum("nij,nik->njk", rest, rest) / (n - 2)), 0)
        jack = spectra.sum(1) ** 2 / np.maximum((spectra**2).sum(1), 1e-300)
    half = _t_quantile(len(m) - 1) * math.sqrt((len(m) - 1) / len(m) * ((np.array(jack) - np.mean(jack)) ** 2).sum()) if len(jack) else math.nan
    return {
        "values": val, "vectors": vec, "scores": z @ vec, "effective_dim": dim(val), "total_variance": total, "entropy": h, "entropy_norm": h / math.log2(len(val)) if len(val) > 1 else 0.0,
        "condition_number": val[0] / val[-1] if val[-1] > 1e-12 else math.inf, "ratio": val[1] / val[0] if len(val) > 1 and val[0] > 0 else math.nan, "half": half,
    }


_GEOMETRY = "cohort string, signal_0_end double, engine string, n_signals int, " + ", ".join(f"eigenvalue_{i} double, explained_{i} double" for i in range(1, 6)) + ", effective_dim double, effective_dim_low double, effective_dim_high double, total_variance double, eigenvalue_entropy double, eigenvalue_entropy_norm double, condition_number double, eigenvalue_ratio double, signals array<string>, features array<string>, pc_loadings array<double>, feature_loadings array<double>"


def cohort_geometry(windows: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """Spectrum by (cohort, window end, feature group), with the signals' and features' first loadings beside it."""

    cols = sorted({c for g in groups.values() for c in g})
    names = [c.split()[0] for c in _GEOMETRY.split(", ")]

    def of(cohort: str, end: float, members: np.ndarray) -> list[list]:
        out = []
        signals = [m["signal_id"] for m in members]
        every = np.array([[np.nan if m[c] is None else m[c] for c in cols] for m in members], float)
        for name, group in groups.items():
            m = every[:, [cols.index(c) for c in group]]
            ok = np.isfinite(m).all(1)
            e = eigen(m[ok])
            if e is None:
                continue
            val = np.pad(e["values"][:5], (0, max(0, 5 - len(e["values"]))), constant_values=np.nan)
            sign = 1 if e["vectors"][np.abs(e["vectors"][:, 0]).argmax(), 0] > 0 else -1  # one of two directions, always the same
            row = [cohort, end, name, int(ok.sum()), *[x for v in val for x in (v, v / e["total_variance"])], e["effective_dim"], e["effective_dim"] - e["half"], e["effective_dim"] + e["half"], e["total_variance"], e["entropy"], e["entropy_norm"], e["condition_number"], e["ratio"]]
            out.append([*row, [n for n, k in zip(signals, ok) if k], group, (sign * e["scores"][:, 0]).tolist(), (sign * e["vectors"][:, 0]).tolist()])
        return out

    def run(batches):
        for pdf in batches:
            rows = [r for x in pdf.itertuples() for r in of(x.cohort, x.signal_0_end, x.members)]
            yield pd.DataFrame(rows, columns=names)

    # a window's signals of one cohort: a small matrix each, many of them a batch
    packed = windows.groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("signal_id", *cols))).alias("members"))
    return packed.mapInPandas(run, _GEOMETRY)


def signal_positions(geometry: DataFrame) -> DataFrame:
    return geometry.select(*AT, "engine", F.explode(F.arrays_zip("signals", "pc_loadings")).alias("x")).select(*AT, "engine", F.col("x.signals").alias("signal_id"), F.col("x.pc_loadings").alias("pc1_loading"))


def feature_loadings(geometry: DataFrame) -> DataFrame:
    return geometry.select(*AT, "engine", F.explode(F.arrays_zip("features", "feature_loadings")).alias("x")).select(*AT, "engine", F.col("x.features").alias("feature"), F.col("x.feature_loadings").alias("pc1_loading"))


def dominance(positions: DataFrame) -> DataFrame:
    """Signals ranked by mean absolute first loading, by engine."""
    s = positions.groupBy("engine", "cohort", "signal_id").agg(F.avg(F.abs("pc1_loading")).alias("mean_abs_pc1"), F.max_by(F.abs("pc1_loading"), "signal_0_end").alias("final_abs_pc1"), F.signum(F.avg("pc1_loading")).alias("sign"), F.count(F.lit(1)).alias("n_windows"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("mean_abs_pc1"), "cohort", "signal_id")))


def signal_geometry(windows: DataFrame, features: list[str], keys: list[str] = AT) -> DataFrame:
    """Distance of each signal from its window's centroid, its length, and the share of the window's squared distances."""
    w = Window.partitionBy(*keys)
    df = windows.withColumns({f"__{f}": F.avg(_finite(f)).over(w) for f in features})
    sq = reduce(Column.__add__, [(F.col(f) - F.col(f"__{f}")) ** 2 for f in features])
    length = F.sqrt(reduce(Column.__add__, [F.col(f) ** 2 for f in features]))
    df = df.withColumns({"__sq": sq, "magnitude": length})
    return df.select(*keys, "signal_id", F.sqrt("__sq").alias("distance"), "magnitude", guarded(F.col("__sq"), F.sum("__sq").over(w), 1e-12).alias("contribution"))


def dynamics(geometry: DataFrame, value: str = "effective_dim", keys: tuple[str, ...] = ("cohort", "engine"), smooth: int = 1) -> DataFrame:
    """Velocity, acceleration, jerk, curvature and speed of a geometry series over its own coordinate; zero under three rows.

    smooth: the series is first replaced by means of so many rows (odd), as if zeros lay beyond its ends, where it is longer."""
    w = Window.partitionBy(*keys).orderBy("signal_0_end")
    df = geometry.select(*keys, "signal_0_end", value).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if smooth > 1:
        near = F.sum(value).over(w.rowsBetween(-(smooth // 2), smooth // 2)) / smooth
        df = df.withColumn(value, F.when(F.col("__n") > smooth, near).otherwise(F.col(value)))
    for new, old in (("velocity", value), ("acceleration", "velocity"), ("jerk", "acceleration")):
        df = df.withColumn(new, F.when(F.col("__n") >= 3, gradient(F.col(old), F.col("signal_0_end"), w)).otherwise(0.0))
    return df.drop("__n").withColumns({"curvature": F.abs("acceleration") / F.pow(1 + F.col("velocity") ** 2, 1.5), "speed": F.abs("velocity")})


def collapse(series: DataFrame, limit: float = -0.05, least: int = 3, keys: tuple[str, ...] = ("cohort", "engine")) -> DataFrame:
    """The longest run of velocity under the limit, of at least so many rows, by series (the first of equal ones)."""
    w = Window.partitionBy(*keys).orderBy("signal_0_end")
    low = F.coalesce(F.col("velocity") < limit, F.lit(False))
    rn = F.row_number().over(w)
    island = rn - F.sum(low.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = series.select(*keys, "signal_0_end", low.alias("low"), island.alias("island"), rn.alias("rn")).where("low").groupBy(*keys, "island").agg(F.min("signal_0_end").alias("onset"), F.max("signal_0_end").alias("end"), F.count(F.lit(1)).alias("length"))
    best = F.max_by(F.struct("onset", "end", "length"), F.struct("length", -F.col("onset")))
    return runs.where(F.col("length") >= least).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.onset").alias("onset"), F.col("b.end").alias("end"), F.col("b.length").alias("length"))


def thermodynamics(geometry: DataFrame) -> DataFrame:
    """By cohort: energy (mean effective dimension), temperature (variance of its steps over the coordinate, rows in order of
    window end and engine), entropy of all positive eigenvalues of all windows, free energy, and the number of rows."""
    w = Window.partitionBy("cohort").orderBy("signal_0_end", "engine")
    dt = F.col("signal_0_end") - F.lag("signal_0_end").over(w)
    step = (F.col("effective_dim") - F.lag("effective_dim").over(w)) / F.when(F.abs(dt) < 1e-12, 1e-12).otherwise(dt)
    vals = F.array(*[F.col(f"eigenvalue_{i}") for i in range(1, 6) if f"eigenvalue_{i}" in geometry.columns])
    df = geometry.withColumns({"__v": step, "__e": F.filter(vals, lambda x: (x > 0) & ~F.isnan(x))})
    total = F.aggregate("__e", F.lit(0.0), lambda acc, x: acc + x)
    df = df.withColumn("__total", F.sum(total).over(Window.partitionBy("cohort")))
    h = F.aggregate("__e", F.lit(0.0), lambda acc, x: acc - x / F.col("__total") * F.ln(x / F.col("__total") + 1e-10))
    out = df.groupBy("cohort").agg(F.sum(h).alias("entropy"), F.avg("effective_dim").alias("energy"), F.stddev_samp("effective_dim").alias("energy_std"), F.when(F.count("__v") >= 2, F.var_pop("__v")).alias("temperature"), F.count(F.lit(1)).alias("n_samples"))
    return out.withColumn("free_energy", F.col("energy") - F.col("temperature") * F.col("entropy"))


def velocity_field(obs: DataFrame, components: bool = False) -> DataFrame:
    """Motion of a cohort's z-scored state between neighbouring rows: speed, acceleration along and across it, curvature, the
    signals that move most, and how many signals share the motion (the exponential of the entropy of the direction).

    components: the velocity of each signal instead. One shuffle by series and one by row: no join."""
    series = Window.partitionBy("cohort", "signal_id")
    w = series.orderBy("signal_0")
    m, s = F.avg("value").over(series), F.stddev_pop("value").over(series)
    z = obs.select("cohort", "signal_id", "signal_0", F.when(s > 1e-10, guarded(F.col("value") - m, s, 1e-10)).otherwise(F.col("value")).alias("z"))
    gap = F.lead("signal_0").over(w) - F.col("signal_0")
    v = z.withColumn("dt", F.when(gap < 1e-12, 1e-12).otherwise(gap)).withColumns({"v": (F.lead("z").over(w) - F.col("z")) / F.col("dt"), "end": F.lead("signal_0").over(w)})
    if components:
        return v.where("v is not null").select("cohort", "signal_id", F.col("signal_0").alias("signal_0_start"), F.col("end").alias("signal_0_end"), F.col("v").alias("velocity"))
    v = v.withColumn("a", (F.lead("v").over(w) - F.col("v")) / ((F.col("dt") + F.lead("dt").over(w)) / 2)).where("a is not null")
    at = ["cohort", "signal_0", "end"]
    row = Window.partitionBy(*at)
    v = v.withColumns({"vv": F.sum(F.col("v") ** 2).over(row), "n": F.count(F.lit(1)).over(row)})
    share = (F.when(F.col("vv") > 1e-24, F.col("v") ** 2 / F.when(F.col("vv") > 1e-24, F.col("vv"))).otherwise(0.0) + 1e-12) / (F.when(F.col("vv") > 1e-24, 1.0).otherwise(0.0) + F.col("n") * 1e-12)
    most = lambda c: F.min_by("signal_id", F.struct(-F.abs(c), "signal_id"))
    g = v.withColumn("share", share).groupBy(*at).agg(F.max("n").alias("n_signals"), F.max("vv").alias("vv"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("v") * F.col("a")).alias("va"), most("v").alias("dominant_motion_signal"), F.max(F.abs("v")).alias("top"), most("a").alias("dominant_accel_signal"), F.exp(-F.sum(F.col("share") * F.ln(F.col("share") + 1e-12))).alias("motion_dimensionality"))
    speed = F.sqrt("vv")
    along = F.coalesce(guarded(F.col("va"), speed, 1e-12), F.lit(0.0))
    across = F.sqrt(F.greatest(F.col("aa") - along**2, F.lit(0.0)))
    return g.select(
        "cohort", F.col("end").alias("signal_0_end"), F.col("signal_0").alias("signal_0_start"), "n_signals", speed.alias("speed"), F.sqrt("aa").alias("acceleration_magnitude"), along.alias("acceleration_parallel"), across.alias("acceleration_perpendicular"),
        (across / (F.col("vv") + 1e-12)).alias("curvature"), "dominant_motion_signal", F.coalesce(guarded(F.col("top"), speed, 1e-12), F.lit(0.0)).alias("dominant_motion_fraction"), "dominant_accel_signal", "motion_dimensionality",
    )


def arc_length(field: DataFrame) -> DataFrame:
    w = Window.partitionBy("cohort").orderBy("signal_0_end")
    step = F.col("speed") * (F.col("signal_0_end") - F.col("signal_0_start"))
    return field.withColumn("arc_length", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def baseline(obs: DataFrame, share: float = 0.2) -> DataFrame:
    """Mean and spread of each signal over the first part of its series."""
    w = Window.partitionBy("cohort", "signal_id")
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("signal_0"))
    head = obs.withColumns({"__n": n, "__r": rn}).where(F.col("__r") <= F.ceil(F.col("__n") * share))
    return head.groupBy("cohort", "signal_id").agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"), F.count(F.lit(1)).alias("base_n"))


def observation_scores(obs: DataFrame, base: DataFrame) -> DataFrame:
    """Distance of every row's state from the baseline in its standard deviations, over the root of the dimension."""
    z = guarded(F.col("value") - F.col("base_mean"), F.col("base_std"), 1e-10)
    s = obs.join(base, ["cohort", "signal_id"]).withColumn("z", z).groupBy("cohort", "signal_0").agg(F.count("z").alias("n_signals"), F.sum(F.col("z") ** 2).alias("zz"), F.max(F.abs("z")).alias("max_z"))
    return s.select("cohort", "signal_0", "n_signals", F.sqrt("zz").alias("distance"), F.sqrt(guarded(F.col("zz"), F.col("n_signals"))).alias("distance_norm"), "max_z")


def system_vector(geometry: DataFrame) -> DataFrame:
    """Over cohorts at one window end: how many, and mean and spread of each engine's dimension."""
    engines = list(GROUPS)
    return geometry.groupBy("signal_0_end").pivot("engine", engines).agg(F.count(F.lit(1)).alias("n"), F.avg("effective_dim").alias("mean_dim"), F.stddev_pop("effective_dim").alias("std_dim"), F.avg("total_variance").alias("mean_variance"))


def wide(geometry: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Geometry by engine side by side, and the step of each effective dimension."""
    metrics = ["effective_dim", "total_variance", "condition_number", "eigenvalue_entropy", "eigenvalue_1"]
    p = geometry.groupBy(*AT).pivot("engine", engines or list(GROUPS)).agg(*[F.first(m).alias(m) for m in metrics])
    w = Window.partitionBy("cohort").orderBy("signal_0_end")
    return p.withColumns({f"{e}_eff_dim_rate": F.col(f"{e}_effective_dim") - F.lag(f"{e}_effective_dim").over(w) for e in engines or list(GROUPS)})
