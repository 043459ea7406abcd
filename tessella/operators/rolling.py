"""Values that roll along a series: any engine at its windows' ends, robust departures, crossings and changes of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as s
from .grouped import _cohorts, _series
from .signal_vector import KEYS, signal_vector
from .windows import SERIES, arrays, guarded, ordered, r_squared

#: Named sets of engines.
PRESETS = {"statistics": ["statistics"], "memory": ["memory"], "complexity": ["complexity"], "spectral": ["spectral"], "trend": ["trend"]}


def rolling(obs: DataFrame, names: list[str] | str, window: int, stride: int) -> DataFrame:
    """Every row with rolling_{output} of the engines (or of a preset) over the window that ends there, null elsewhere.

    Coordinates of a series are distinct; a series shorter than the window has nulls only."""
    names = PRESETS[names] if isinstance(names, str) else names
    made = signal_vector(obs, names, window, stride, overrides={n: window for n in names})
    outs = [c for c in made.columns if c not in KEYS]
    at = made.select(*SERIES, F.col("signal_0_end").alias("signal_0"), *[F.col(c).alias(f"rolling_{c}") for c in outs])
    return obs.join(at, [*SERIES, "signal_0"], "left")


def rolling_departures(obs: DataFrame, reach: int = 50) -> DataFrame:
    """Departure from the median of the rows around (reach to each side), over the median of such departures around.

    The score is 0 where that spread is under 1e-10; null values have no score and are no departure."""
    w = ordered().rowsBetween(-reach, reach)
    df = obs.withColumn("rolling_median", F.percentile("value", 0.5).over(w))
    df = df.withColumn("__d", F.abs(F.col("value") - F.col("rolling_median"))).withColumn("rolling_mad", F.percentile("__d", 0.5).over(w)).drop("__d")
    score = F.when(F.col("rolling_mad") > 1e-10, 0.6745 * guarded(F.col("value") - F.col("rolling_median"), F.col("rolling_mad"), 1e-10)).when(F.col("value").isNotNull(), 0.0)
    return df.withColumn("mad_score", score).withColumn("is_departure", F.coalesce(F.abs("mad_score") > 3.5, F.lit(False)))


def changes(obs: DataFrame, width: int = 32, stride: int = 8, bins: int = 10) -> DataFrame:
    """Of each window's numbers: crossings of zero and of the mean, changes of level, and steps in units of the spread.

    Levels are the values themselves where there are few, else so many equal bins. Under two numbers there are no crossings and no
    count of changes (null); under three no steps. A window without spread has its steps as they are."""
    v = F.filter("values", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = arrays(obs, width, stride).withColumn("v", v).withColumn("n", F.size("v"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("m", total(F.col("v")) / F.when(F.col("n") > 0, F.col("n")))
    df = df.withColumn("sd", F.sqrt(total(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))) / F.when(F.col("n") > 0, F.col("n"))))
    rest = F.greatest(F.col("n") - 1, F.lit(0))
    steps = lambda of: F.zip_with(F.slice(F.col("v"), F.lit(2), rest), F.slice(F.col("v"), F.lit(1), rest), of)
    turns = lambda of: F.size(F.filter(steps(lambda b, a: of(b) != of(a)), lambda x: x))
    low, high = F.array_min("v"), F.array_max("v")
    edge = lambda j: F.when(j == bins, F.col("hi")).otherwise(F.col("lo") + j * ((F.col("hi") - F.col("lo")) / bins))
    level = lambda x: F.when(F.col("few"), x).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.lit(bins)), lambda j: edge(j) < x)).cast("double"))
    df = df.withColumns({"lo": low, "hi": high, "few": F.size(F.array_distinct("v")) <= bins})
    roc = steps(lambda b, a: (b - a) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    df = df.withColumns({"roc": roc, "zero_crossings": turns(F.signum), "mean_crossings": turns(lambda x: F.signum(x - F.col("m"))), "transition_count": F.when(F.col("n") >= 2, turns(level))})
    k, some = F.when(F.col("n") >= 3, rest), F.col("n") >= 3
    df = df.withColumn("mean_roc", total(F.col("roc")) / k)
    var = total(F.transform("roc", lambda x: (x - F.col("mean_roc")) * (x - F.col("mean_roc")))) / k
    return df.withColumns({"std_roc": F.sqrt(var), "max_roc": F.when(some, F.array_max(F.transform("roc", F.abs)))}).select(*SERIES, "window_id", "signal_0_end", "zero_crossings", "mean_crossings", "transition_count", "mean_roc", "std_roc", "max_roc")


def trend_of(rows: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """Slope and r2 of a value over its place among its series' rows, from four numbers on; nulls hold their places."""
    x = F.when(~F.isnan(value), F.col(value))
    df = rows.select(*keys, x.alias("y"), (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("double").alias("i"))
    at = F.when(F.col("y").isNotNull(), F.col("i"))
    enough = F.count("y") >= 4
    return df.groupBy(*keys).agg(F.when(enough, F.regr_slope(F.col("y"), at)).alias(f"{value}_slope"), F.when(enough, r_squared(F.col("y"), at)).alias(f"{value}_r2"))


def _hops(n: int, window: int, stride: int) -> range:
    return range(0, n - window + 1, stride)


def rolling_lyapunov(obs: DataFrame, window: int = 500, stride: int = 50, least: int = 200) -> DataFrame:
    """Largest exponent and confidence of hopping windows, at their ends; windows without an exponent have no row."""

    def of(y, t):
        got = [(i + window - 1, s.ftle(y[i : i + window], least)) for i in _hops(len(y), window, stride)] if window >= least else []
        return [{"signal_0_end": t[e], "lyapunov": r["ftle"], "lyapunov_confidence": r["confidence"]} for e, r in got if np.isfinite(r["ftle"])]

    return _series(obs, of, "signal_0_end double, lyapunov double, lyapunov_confidence double")


def rolling_saddles(obs: DataFrame, window: int = 200, stride: int = 20, least: int = 100) -> DataFrame:
    """Saddle score at the end of hopping windows, and the stability of the basin there."""

    def of(y, t):
        got = [(i + window - 1, s.saddles(y[i : i + window], least, window)) for i in _hops(len(y), window, stride)] if window >= least else []
        return [{"signal_0_end": t[e], "saddle_score": r["last_saddle_score"], "basin_stability": r["basin_stability"]} for e, r in got if np.isfinite(r["basin_stability"])]

    return _series(obs, of, "signal_0_end double, saddle_score double, basin_stability double")


def rolling_sensitivity(obs: DataFrame, window: int = 100, stride: int = 10, horizon: int = 10) -> DataFrame:
    """By hopping window of a cohort: each signal's sensitivity, and whether it is the most sensitive one (the first of equal ones)."""

    def of(m, names, t):
        out = []
        for i in _hops(len(m), window, stride):
            v = s.sensitivity(m[i : i + window], horizon)
            top = int(np.nanargmax(v)) if np.isfinite(v).any() else -1
            out += [{"signal_0_end": t[i + window - 1], "signal_id": n, "sensitivity": x, "is_dominant": j == top} for j, (n, x) in enumerate(zip(names, v))]
        return out

    return _cohorts(obs, of, "signal_0_end double, signal_id string, sensitivity double, is_dominant boolean")


def constant_by_typology(typology: DataFrame) -> DataFrame:
    """signal_id of the signals that a typology calls constant: by temporal_primary, else temporal_pattern, and by continuity."""
    cols = [c for c in ("temporal_primary", "temporal_pattern") if c in typology.columns][:1] + [c for c in ("continuity",) if c in typology.columns]
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c) == "CONSTANT", F.lit(False))
    return typology.where(hit).select("signal_id").distinct()


def _active(typology: DataFrame) -> Column:
    if "is_constant" in typology.columns:
        return ~F.col("is_constant")
    return F.col("signal_std") > 1e-10 if "signal_std" in typology.columns else F.lit(True)


def active(rows: DataFrame, typology: DataFrame) -> DataFrame:
    """Rows of signals that the typology lists as not constant (is_constant, else signal_std over 1e-10, else all that it lists)."""
    return rows.join(typology.where(_active(typology)).select("signal_id").distinct(), "signal_id", "left_semi")


def unlisted(obs: DataFrame, typology: DataFrame) -> DataFrame:
    """signal_id of signals that have rows but no typology."""
    return obs.select("signal_id").distinct().join(typology.select("signal_id"), "signal_id", "left_anti")
