"""A cohort's signals side by side: gaps filled, windows of shared coordinates, stability, spectra, baselines and views of trajectories."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions import series as s
from .geometry import AT, eigen
from .windows import SERIES, guarded

_NAN = float("nan")


def _number(c: str = "value") -> Column:
    return F.when(~F.isnan(c), F.col(c))


def gridded(obs: DataFrame) -> DataFrame:
    """Each signal of a cohort at each coordinate of the cohort.

    What is missing, null or no number lies on the line between its neighbours, counted in rows; before the first and after the
    last value, that value. A signal without values stays null. Of rows that share a coordinate the smallest value counts."""
    held = obs.groupBy(*SERIES, "signal_0").agg(F.min(_number()).alias("value"))
    every = obs.select("cohort", "signal_0").distinct().join(obs.select(*SERIES).distinct(), "cohort")
    w = Window.partitionBy(*SERIES)
    df = every.join(held, [*SERIES, "signal_0"], "left").withColumn("__i", F.row_number().over(w.orderBy("signal_0")))
    at = F.when(F.col("value").isNotNull(), F.struct("__i", "value"))
    past = Window.unboundedPreceding, 0
    df = df.withColumns({"__a": F.last(at, ignorenulls=True).over(w.orderBy("signal_0").rowsBetween(*past)), "__b": F.last(at, ignorenulls=True).over(w.orderBy(F.desc("signal_0")).rowsBetween(*past))})
    a, b = F.col("__a"), F.col("__b")
    line = a["value"] + guarded((b["value"] - a["value"]) * (F.col("__i") - a["__i"]), (b["__i"] - a["__i"]).cast("double"))
    return df.select(*SERIES, "signal_0", F.when(F.col("value").isNotNull(), F.col("value")).when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(line).alias("value"))


def coordinate_windows(obs: DataFrame, width: int, stride: int, least: int) -> DataFrame:
    """Rows once for each window over the cohort's distinct coordinates that holds them, from the first coordinate on (rn, window_id).

    A cohort of fewer coordinates has one window of them all; so has any cohort if windows are shorter than least."""
    at = Window.partitionBy("cohort")
    rn = F.dense_rank().over(at.orderBy("signal_0")) - 1
    df = obs.withColumn("rn", rn.cast("long")).withColumn("__n", F.max("rn").over(at) + 1)
    size = F.col("__n") if width < least else F.least(F.lit(width), F.col("__n"))
    low = F.greatest(F.ceil((F.col("rn") - size + 1) / stride), F.lit(0))
    high = F.least(F.floor(F.col("rn") / stride), F.floor((F.col("__n") - size) / stride))
    return df.withColumn("window_id", F.explode(F.when(high >= low, F.sequence(low, high)))).drop("__n")


def _span() -> list[Column]:
    return [F.min("signal_0").alias("signal_0_start"), F.max("signal_0").alias("signal_0_end")]


def _center() -> Column:
    return ((F.col("signal_0_start") + F.col("signal_0_end")) / 2).alias("signal_0_center")


#: Measures of a window's signals as name, column of the kernels, statistic.
HILBERT = [("h_freq_stability_mean", "inst_freq_stability", "mean"), ("h_freq_stability_min", "inst_freq_stability", "min"), ("h_freq_std_max", "inst_freq_std", "max"), ("h_freq_drift_mean", "inst_freq_drift", "mean"), ("h_freq_drift_spread", "inst_freq_drift", "spread"), ("h_amp_cv_mean", "inst_amp_cv", "mean"), ("h_amp_trend_mean", "inst_amp_trend", "mean"), ("h_phase_coherence_mean", "phase_coherence", "mean"), ("h_phase_coherence_min", "phase_coherence", "min"), ("h_am_fm_ratio_mean", "am_fm_ratio", "mean")]
WAVELET = [("w_energy_low_mean", "wavelet_energy_low", "mean"), ("w_energy_high_mean", "wavelet_energy_high", "mean"), ("w_energy_ratio_mean", "wavelet_energy_ratio", "mean"), ("w_entropy_mean", "wavelet_entropy", "mean"), ("w_concentration_mean", "wavelet_concentration", "mean"), ("w_energy_drift_mean", "wavelet_energy_drift", "mean"), ("w_energy_drift_max", "wavelet_energy_drift", "max"), ("w_temporal_std_mean", "wavelet_temporal_std", "mean"), ("w_intermittency_mean", "wavelet_intermittency", "mean"), ("w_intermittency_max", "wavelet_intermittency", "max")]


def signal_stability(obs: DataFrame, width: int = 30, stride: int = 5) -> DataFrame:
    """By window of a cohort: what the signals' Hilbert and spectral-energy measures are on average and at worst.

    Signals with under ten numbers in a window are counted (from four and eight numbers on) but have no measures."""
    outs = sorted({c for _, c, _ in HILBERT + WAVELET})
    df = coordinate_windows(obs, width, stride, 8)
    spans = df.groupBy("cohort", "window_id").agg(*_span())
    finite = _number().isNotNull() & (F.abs("value") < float("inf"))
    xs = df.groupBy("cohort", "window_id", "signal_id").agg(F.transform(F.array_sort(F.collect_list(F.when(finite, F.struct("rn", "value")))), lambda x: x["value"]).alias("xs"))

    def run(batches):
        for pdf in batches:
            made = {c: np.full(len(pdf), np.nan) for c in outs}
            size = pdf["xs"].map(len).to_numpy()
            for n in np.unique(size[size >= 10]):
                at = np.flatnonzero(size == n)
                x = np.array([pdf["xs"].iat[i] for i in at], float)
                with np.errstate(all="ignore"):
                    got = k.hilbert_stability(x) | k.wavelet_stability(x)
                for c in outs:
                    made[c][at] = got[c]
            yield pd.DataFrame({"cohort": pdf["cohort"], "window_id": pdf["window_id"], "n": size, **made})

    got = xs.mapInPandas(run, "cohort string, window_id long, n long, " + ", ".join(f"{c} double" for c in outs))
    of = {"mean": F.avg, "min": F.min, "max": F.max, "spread": lambda c: F.when(F.count(c) > 1, F.stddev_pop(c))}
    g = got.groupBy("cohort", "window_id").agg(F.count_if(F.col("n") >= 4).alias("n_hilbert_signals"), F.count_if(F.col("n") >= 8).alias("n_wavelet_signals"), *[of[how](_number(c)).alias(name) for name, c, how in HILBERT + WAVELET])
    signals = obs.select(*SERIES).distinct().groupBy("cohort").agg(F.count(F.lit(1)).alias("n_signals"))
    return spans.join(g, ["cohort", "window_id"]).join(signals, "cohort").select("cohort", "signal_0_start", "signal_0_end", _center(), "n_signals", "n_hilbert_signals", "n_wavelet_signals", *[n for n, _, _ in HILBERT + WAVELET])


_EIGEN = "cohort string, signal_0_start double, signal_0_end double, signal_0_center double, n_signals int, n_samples int, effective_dim double, eff_dim_entropy double, eigenvalue_entropy double, eigenvalue_entropy_normalized double, total_variance double, condition_number double, ratio_2_1 double, ratio_3_1 double, energy_concentration double, " + ", ".join(f"eigenvalue_{i} double" for i in range(5)) + ", " + ", ".join(f"explained_ratio_{i} double" for i in range(3))


def sensor_eigen(obs: DataFrame, width: int = 30, stride: int = 5, look: int = 30) -> DataFrame:
    """Spectrum of a cohort's signals over the newest windows: means by signal and window, then the eigenvalues of the last rows of them.

    Signals with a gap in those rows are left out; under three rows or two signals, or where a signal is constant, measures are null.
    Cohorts with under two signals or three windows have no rows."""
    df = coordinate_windows(obs, width, stride, 10)
    means = df.groupBy("cohort", "window_id", "signal_id").agg(F.avg(_number()).alias("m"), *_span())
    rows = means.groupBy("cohort", "window_id").agg(F.min("signal_0_start").alias("signal_0_start"), F.max("signal_0_end").alias("signal_0_end"), F.array_sort(F.collect_list(F.struct("signal_id", "m"))).alias("row"))
    signals = obs.select(*SERIES).distinct().groupBy("cohort").agg(F.array_sort(F.collect_list("signal_id")).alias("signals"))
    at = Window.partitionBy("cohort")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(at)).where("__n >= 3").join(signals.where("size(signals) >= 2"), "cohort")
    aligned = F.transform("signals", lambda x: F.element_at(F.map_from_entries("row"), x))
    held = rows.withColumn("x", F.struct(aligned.alias("v"))).withColumn("look", F.collect_list("x").over(at.orderBy("window_id").rowsBetween(-(look - 1), 0)))
    names = [c.split()[0] for c in _EIGEN.split(", ")]

    def of(r) -> dict:
        m = np.array([[_NAN if v is None else v for v in x["v"]] for x in r.look], float)
        out = {"cohort": r.cohort, "signal_0_start": r.signal_0_start, "signal_0_end": r.signal_0_end, "signal_0_center": (r.signal_0_start + r.signal_0_end) / 2, "n_signals": m.shape[1], "n_samples": len(m)}
        m = m[:, ~np.isnan(m).any(0)]
        e = eigen(m) if m.shape[0] >= 3 and m.shape[1] >= 2 else None
        if e is None:
            return out
        v, p = e["values"], e["values"][e["values"] > 0] / e["total_variance"]
        out |= {"n_signals": len(m), "effective_dim": e["effective_dim"], "eff_dim_entropy": float(np.exp(-(p * np.log(p)).sum())), "eigenvalue_entropy": e["entropy"], "eigenvalue_entropy_normalized": e["entropy_norm"], "total_variance": e["total_variance"], "condition_number": e["condition_number"], "ratio_2_1": e["ratio"], "ratio_3_1": v[2] / v[0] if len(v) > 2 else None, "energy_concentration": v[0] / e["total_variance"]}
        return out | {f"eigenvalue_{i}": x for i, x in enumerate(v[:5])} | {f"explained_ratio_{i}": x / e["total_variance"] for i, x in enumerate(v[:3])}

    def run(batches):
        for pdf in batches:
            with np.errstate(all="ignore"):
                made = [of(r) for r in pdf.itertuples()]
            yield pd.DataFrame(made, columns=names).astype({c: float for c in names[6:]})

    return held.select("cohort", "signal_0_start", "signal_0_end", "look").mapInPandas(run, _EIGEN)


def continuous(vectors: list[np.ndarray | None]) -> list[np.ndarray | None]:
    """Eigenvectors (columns) turned so that none points away from the one before it; a gap or another shape starts anew."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        before = out[-1] if out else None
        if v is not None and before is not None and v.shape == before.shape:
            v = np.where((v * before).sum(0) < 0, -v, v)
        out.append(v)
    return out


def _covariances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, centroid, std (population) and pairs (i, j, covariance) of rows' arrays x, which have one length in a group.

    A row becomes a term for each pair of its members, and terms combine before the shuffle: no group's rows meet in one task."""
    last = F.size("x") - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("x", i).alias("p"), F.get("x", j).alias("q")))))
    g = rows.select(*keys, F.explode(pairs).alias("t")).groupBy(*keys, "t.i", "t.j").agg(F.count(F.lit(1)).alias("n"), F.avg("t.p").alias("m"), F.stddev_pop("t.p").alias("sd"), F.covar_samp("t.p", "t.q").alias("c"))
    own = F.when(F.col("i") == F.col("j"), F.struct("i", "m", "sd"))
    return g.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(own)).alias("own"), F.collect_list(F.struct("i", "j", "c")).alias("pairs"))


def _spectrum(r, floor: float) -> dict | None:
    """Eigenvalues and vectors of z-scored columns (covariance over n - 1, spread over n); None if one varies by less than the floor."""
    sd = np.array([o["sd"] for o in r.own], float)
    if floor and (sd < floor).any():
        return None
    m = np.zeros((len(sd), len(sd)))
    for t in r.pairs:
        m[t["i"], t["j"]] = m[t["j"], t["i"]] = _NAN if t["c"] is None else t["c"]
    sd = np.where(sd < 1e-12, 1.0, sd)
    if not np.isfinite(m).all():
        return None
    val, vec = np.linalg.eigh(m / np.outer(sd, sd))
    val, vec = np.maximum(val[::-1], 0), vec[:, ::-1]
    first = (np.abs(vec) > 1e-9).argmax(0)  # one of two directions, always the same
    vec = vec * np.sign(vec[first, np.arange(len(val))])
    return {"sd": sd, "mean": np.array([o["m"] for o in r.own], float), "values": val, "vectors": vec, "total": float(val.sum()), "dim": float(val.sum() ** 2 / max((val**2).sum(), 1e-300))}


_SEGMENT = "n_samples long, eff_dim double, eigenvalue_1 double, explained_1 double, condition_number double, spectral_gap double"


def segment_comparison(obs: DataFrame, bounds: list[tuple[str, float, float | None]] | None = None) -> DataFrame:
    """Spectra of a cohort's signals in neighbouring segments, and how dimension and first eigenvalue change.

    bounds: name, first and last coordinate (both inclusive; None: no end). Without bounds: the first 20 % of the coordinate's range
    (pre) and the rest (post). Segments need ten values, two signals, and complete rows: five and twice the number of signals."""
    if bounds is None:
        split = (F.max("signal_0").over(Window.partitionBy("cohort")) * 0.20).cast("long")
        name = F.when((F.col("signal_0") >= 0) & (F.col("signal_0") <= split), F.lit(0)).when(F.col("signal_0") >= split + 1, F.lit(1))
        df, names = obs.withColumn("segment", name).where("segment is not null"), ["pre", "post"]
    else:
        inside = [F.when((F.col("signal_0") >= a) & ((F.col("signal_0") <= b) if b is not None else F.lit(True)), F.lit(i)) for i, (_, a, b) in enumerate(bounds)]
        df, names = obs.withColumn("segment", F.explode(F.array_compact(F.array(*inside)))), [n for n, _, _ in bounds]
    keys = ["cohort", "segment"]
    known = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.count_distinct("signal_id").alias("__k")).where("__rows >= 10 and __k >= 2").drop("__rows")
    rows = df.groupBy(*keys, "signal_0", "signal_id").agg(F.min(_number()).alias("v")).where("v is not null")
    rows = rows.groupBy(*keys, "signal_0").agg(F.transform(F.array_sort(F.collect_list(F.struct("signal_id", "v"))), lambda x: x["v"]).alias("x")).join(known, keys).where(F.size("x") == F.col("__k"))
    found = _covariances(rows, keys).where(F.col("n") >= F.greatest(F.lit(5), 2 * F.size("own")))

    def run(batches):
        for pdf in batches:
            made = []
            for r in pdf.itertuples():
                e = _spectrum(r, 1e-10)
                v = e["values"] if e else None
                made.append([r.cohort, r.segment, r.n, *([e["dim"], v[0], v[0] / e["total"], v[0] / v[-1] if v[-1] > 1e-12 else float("inf"), v[1] / v[0]] if e else [None] * 5)])
            yield pd.DataFrame(made, columns=[*keys, *[c.split()[0] for c in _SEGMENT.split(", ")]]).astype({c.split()[0]: float for c in _SEGMENT.split(", ")[1:]})

    one = found.mapInPandas(run, "cohort string, segment int, " + _SEGMENT)
    w = Window.partitionBy("cohort").orderBy("segment")
    cols = ["segment", "n_samples", "eff_dim", "eigenvalue_1", "explained_1", "condition_number", "spectral_gap"]
    two = one.withColumns({f"{c}_b": F.lead(c).over(w) for c in cols}).withColumnsRenamed({c: f"{c}_a" for c in cols}).where("segment_b is not null")
    label = F.array(*[F.lit(n) for n in names])
    two = two.withColumns({"segment_a": F.get(label, F.col("segment_a")), "segment_b": F.get(label, F.col("segment_b"))})
    return two.withColumns({"eff_dim_delta": F.col("eff_dim_b") - F.col("eff_dim_a"), "eigenvalue_1_delta": F.col("eigenvalue_1_b") - F.col("eigenvalue_1_a")})


_BASE = "cohort string, n_baseline long, effective_dim double, total_variance double, signal_id string, centroid double, std double, directions array<double>, eigenvalues array<double>"


def baseline_spectrum(obs: DataFrame, share: float = 0.2, fleet: bool = True) -> DataFrame:
    """What early life looks like: by signal its mean, spread and part in the first five directions, with the eigenvalues beside it.

    Early life is the first share of a cohort's rows, three at least, gaps filled; cohorts of under five rows have none. fleet: all
    cohorts' early rows together, a signal that a cohort lacks counting as 0. Directions begin with a positive part; a signal that
    does not vary has std 1."""
    grid = gridded(obs).withColumn("value", F.coalesce("value", F.lit(0.0)))
    w = Window.partitionBy("cohort")
    rows = grid.groupBy("cohort", "signal_0").agg(F.map_from_entries(F.collect_list(F.struct("signal_id", "value"))).alias("row"))
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy("signal_0"))})
    early = rows.where((F.col("__n") >= 5) & (F.col("__r") <= F.greatest(F.lit(3), F.floor(F.col("__n") * share))))
    key = F.lit("fleet") if fleet else F.col("cohort")
    signals = obs.select(key.alias("__key"), "signal_id").distinct().groupBy("__key").agg(F.array_sort(F.collect_list("signal_id")).alias("signals"))
    x = F.transform("signals", lambda n: F.coalesce(F.element_at("row", n), F.lit(0.0)))
    found = early.withColumn("__key", key).join(signals, "__key")
    spectra = _covariances(found.select("__key", x.alias("x")), ["__key"]).join(signals, "__key").withColumnRenamed("__key", "cohort")

    def run(batches):
        for pdf in batches:
            made = []
            for r in pdf.itertuples():
                e = _spectrum(r, 0.0) if len(r.own) >= 2 and r.n >= 2 else None
                if e:
                    made += [[r.cohort, r.n, e["dim"] if e["total"] > 0 else 0.0, e["total"], n, e["mean"][i], e["sd"][i], e["vectors"][i, :5].tolist(), e["values"][:5].tolist()] for i, n in enumerate(r.signals)]
            yield pd.DataFrame(made, columns=[c.split()[0] for c in _BASE.split(", ")])

    return spectra.mapInPandas(run, _BASE)


def baseline_scores(obs: DataFrame, base: DataFrame, fleet: bool = True) -> DataFrame:
    """Each row's distance from the baseline, in all signals and along its directions; rows of cohorts that share under two signals go.

    Gaps are filled first; a signal without values, or one that the cohort lacks, counts as the baseline's mean. Directions without
    variance are left out of the Mahalanobis distance."""
    b = base.select(*([] if fleet else ["cohort"]), "signal_id", "centroid", "std", "directions", "eigenvalues")
    one = Window.partitionBy("cohort") if not fleet else Window.partitionBy(F.lit(1))
    b = b.withColumns({"__k": F.count(F.lit(1)).over(one), "__all": F.sum(F.col("centroid") ** 2).over(one)})  # a row for each signal
    j = gridded(obs).join(b, ["signal_id"] if fleet else SERIES)
    j = j.withColumn("x", F.coalesce("value", "centroid")).withColumn("z", (F.col("x") - F.col("centroid")) / F.col("std"))
    part = lambda i: F.sum(F.col("z") * F.coalesce(F.get("directions", F.lit(i)), F.lit(0.0))).alias(f"p{i}")
    g = j.groupBy("cohort", "signal_0").agg(F.count(F.lit(1)).alias("__n"), F.max("__k").alias("__k"), F.max("eigenvalues").alias("e"), F.sum(F.col("z") ** 2).alias("zz"), (F.sum(F.col("x") ** 2) + F.max("__all") - F.sum(F.col("centroid") ** 2)).alias("xx"), *[part(i) for i in range(5)])
    far = reduce(Column.__add__, [F.coalesce(guarded(F.col(f"p{i}") ** 2, F.get("e", F.lit(i)), 1e-12), F.lit(0.0)) for i in range(5)])
    d = F.sqrt("zz")
    return g.where("__n >= 2").select("cohort", "signal_0", d.alias("centroid_distance"), (d / F.sqrt("__k")).alias("centroid_distance_norm"), F.col("p0").alias("pc1_projection"), F.col("p1").alias("pc2_projection"), F.sqrt(far).alias("mahalanobis_approx"), F.sqrt("xx").alias("sensor_norm"))


def weighted_centroid(windows: DataFrame, features: list[str], weight: str, keys: list[str] = AT, least: int = 2) -> DataFrame:
    """Weighted mean of the complete rows of a window, and their plain distances from it; null under so many rows."""
    whole = reduce(Column.__and__, [_number(f).isNotNull() & (F.abs(f) < float("inf")) for f in features])
    w = Window.partitionBy(*keys)  # the signals of one cohort at one window: few rows
    held = F.when(whole, F.col(weight))
    df = windows.withColumns({"__w": held, "__k": F.count(F.when(whole, F.lit(1))).over(w)}).withColumns({f"state_{f}": guarded(F.sum(F.col("__w") * F.col(f)).over(w), F.sum("__w").over(w)) for f in features})
    d = F.when(whole & (F.col("__k") >= least), F.sqrt(reduce(Column.__add__, [(F.col(f) - F.col(f"state_{f}")) ** 2 for f in features])))
    enough = F.max("__k") >= least
    return df.withColumn("__d", d).groupBy(*keys).agg(F.when(enough, F.max("__k")).otherwise(0).alias("n_signals"), *[F.when(enough, F.max(f"state_{f}")).alias(f"state_{f}") for f in features], F.avg("__d").alias("mean_distance"), F.max("__d").alias("max_distance"), F.stddev_pop("__d").alias("std_distance"))


def histories(windows: DataFrame, features: list[str], last: int = 32) -> DataFrame:
    """cohort, signal_0_end (each end of a window of the cohort) and xs: by signal the newest windows that are centred no later.

    An as-of join by one sort: ends are marker rows among a signal's windows, and take the list that stands last before them."""
    own = Window.partitionBy(*SERIES)
    lists = windows.select(*SERIES, F.col("signal_0_center").alias("at"), F.lit(0).alias("mark"), F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).over(own.orderBy("signal_0_center").rowsBetween(-(last - 1), 0)).alias("xs"))
    ends = windows.select("cohort", F.col("signal_0_end").alias("at")).distinct().join(windows.select(*SERIES).distinct(), "cohort")
    both = lists.unionByName(ends.withColumn("mark", F.lit(1)), allowMissingColumns=True)
    seen = both.withColumn("xs", F.last("xs", ignorenulls=True).over(own.orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where("mark = 1 and xs is not null").groupBy("cohort", F.col("at").alias("signal_0_end")).agg(F.array_sort(F.collect_list(F.struct("signal_id", "xs"))).alias("xs"))


_VIEWS = ["fourier_{}_dominant_freq", "fourier_{}_spectral_flatness", "envelope_{}_mean", "envelope_{}_trend", "envelope_{}_cv", "wavelet_{}_dominant_scale", "wavelet_{}_scale_entropy", "wavelet_{}_energy_ratio"]
_LINKS = ["laplacian_algebraic_connectivity", "laplacian_spectral_gap", "laplacian_n_components", "laplacian_max_eigenvalue"]


#: Rows whose paths are held as matrices at once.
ROWS = 2048


def _middle(x: np.ndarray) -> np.ndarray:
    """Median of each row's numbers."""
    x, n = np.sort(x, 1), (~np.isnan(x)).sum(1)[:, None]
    return ((np.take_along_axis(x, np.maximum(n - 1, 0) // 2, 1) + np.take_along_axis(x, n // 2, 1)) / 2)[:, 0]


def _path_views(x: np.ndarray) -> np.ndarray:
    """Of paths of one length: spectrum (from eight points on), envelope (four), shares of spectral energy (ten; flat paths from eight)."""
    out, n = np.full((len(_VIEWS), len(x)), _NAN), x.shape[1]
    if n >= 4:
        hull = np.abs(k.analytic(x))
        mean = hull.mean(1)
        out[2:5] = mean, k.line(hull)[0], np.divide(hull.std(1), mean, out=np.full(len(x), _NAN), where=mean > 0)
    if n >= 8:
        flat = x.std(1) < 1e-10
        out[:2] = k.spectral(x)["dominant_freq"], k.spectral_flatness(x)
        if n >= 10:
            w = k.wavelet_stability(x)
            out[5:] = w["wavelet_dominant_scale"], w["wavelet_entropy"], w["wavelet_energy_ratio"]
        out[5:7, flat], out[7, flat] = 0.0, _NAN
    return out


def _link_views(m: np.ndarray) -> np.ndarray:
    """Spectrum of the normalised Laplacian of the signals' absolute correlations, by row of m (rows, signals, points)."""
    y = m - m.mean(2, keepdims=True)
    c = y @ y.swapaxes(1, 2) / np.array(m.shape[2] - 1.0)
    sd = np.sqrt(np.diagonal(c, axis1=1, axis2=2))
    c = np.abs(np.nan_to_num(np.clip(c / sd[:, :, None] / sd[:, None], -1, 1)))
    c[:, np.arange(m.shape[1]), np.arange(m.shape[1])] = 0
    degree = c.sum(2)
    root = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)
    e = np.linalg.eigvalsh(np.eye(m.shape[1]) * (degree > 0)[:, :, None] - root[:, :, None] * c * root[:, None])
    return np.stack([e[:, 1], np.divide(e[:, 1], e[:, -1], out=np.full(len(e), _NAN), where=e[:, -1] > 0), (e < 1e-10).sum(1), e[:, -1]])


def _row_views(xs: pa.ListArray, features: list[str]) -> list[np.ndarray]:
    """The columns of trajectory_views() of rows of histories(): paths of equal length are one matrix."""
    held = np.diff(xs.offsets.to_numpy())
    lists = xs.flatten().field("xs")
    size, points = np.diff(lists.offsets.to_numpy()), lists.flatten()
    row, of = np.repeat(np.arange(len(xs)), held), np.repeat(np.arange(len(size)), size)
    at, most = np.arange(len(row)) - np.repeat(held.cumsum() - held, held), max(int(held.max(initial=0)), 1)
    joined, end, out = np.zeros((len(size), len(features) * int(size.max(initial=0)))), np.zeros(len(size), np.int64), []
    for f in features:
        v = points.field(f).to_numpy(zero_copy_only=False)
        ok = np.isfinite(v)
        v, p = v[ok], of[ok]
        n = np.bincount(p, minlength=len(size))
        first = n.cumsum() - n
        joined[p, end[p] + np.arange(len(v)) - first[p]] = v
        end += n
        views = np.full((len(_VIEWS), len(xs), most), _NAN)
        for length in np.unique(n):
            here = np.flatnonzero(n == length)
            views[:, row[here], at[here]] = _path_views(v[first[here, None] + np.arange(length)]) if length else _NAN
        out += [_middle(x) for x in views]
    some = np.flatnonzero(end)
    n = np.bincount(row[some], minlength=len(xs))
    first, longest = n.cumsum() - n, np.zeros(len(xs), np.int64)
    np.maximum.at(longest, row, end)
    links = np.full((len(_LINKS), len(xs)), _NAN)
    for signals, length in np.unique(np.column_stack([n, longest]), axis=0):
        here = np.flatnonzero((n == signals) & (longest == length))
        if signals >= 2:
            links[:, here] = _link_views(joined[some[first[here, None] + np.arange(signals)], :length])
    return [*out, *links]


def trajectory_views(windows: DataFrame, features: list[str], last: int = 32) -> DataFrame:
    """How the features of a cohort's signals move, by window end: Fourier, envelope, energy and link views of their newest windows.

    Values that are no numbers are left out of a path; views without a path long enough are null. Of several signals the median; for
    links shorter paths end in zeros. Paths stay Arrow arrays: as objects a batch of them took hundreds of MB."""
    names = [*[v.format(f) for f in features for v in _VIEWS], *_LINKS]

    def run(batches):
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch = whole.slice(a, ROWS)
                with np.errstate(all="ignore"):
                    made = _row_views(batch.column("xs"), features)
                yield pa.RecordBatch.from_arrays([batch.column("cohort"), batch.column("signal_0_end"), *[pa.array(np.asarray(x, float), from_pandas=True) for x in made]], ["cohort", "signal_0_end", *names])

    return histories(windows, features, last).mapInArrow(run, "cohort string, signal_0_end double, " + ", ".join(f"`{c}` double" for c in names))


def state_vector(windows: DataFrame, groups: dict[str, list[str]], last: int = 32) -> DataFrame:
    """By window: spread of the signals about their centroid, each group's centroid, and the views of their trajectories.

    Groups of under two features have no centroid. The windows are read five times here and each reader would build them from all
    rows anew, so the columns that count, a row for each window, are kept for the session."""
    from .geometry import centroid

    cols = sorted({c for g in groups.values() for c in g})
    windows = windows.select(*SERIES, "signal_0_end", "signal_0_center", *cols).persist(StorageLevel.MEMORY_AND_DISK)
    whole = centroid(windows, cols).select(*AT, "n_signals", "mean_distance", "max_distance", "std_distance")
    for name, g in groups.items():
        if len(g) >= 2:
            whole = whole.join(centroid(windows, g).select(*AT, *[F.col(f"state_{f}").alias(f"state_{name}_{f}") for f in g]), AT)
    return whole.join(trajectory_views(windows, cols, last), AT, "left")
