"""Summary, departure, correlation and fingerprint queries over observations, and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SERIES, guarded


def summary(obs: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    m, s = F.avg("value"), F.stddev_samp("value")
    return obs.groupBy(*SERIES).agg(
        F.count("value").alias("n"), m.alias("mean"), s.alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"), q(0.5).alias("median"),
        q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"), F.var_samp("value").alias("variance"), guarded(s, F.abs(m)).alias("cv"),
    )


def _by(keys: list[str]):
    return Window.partitionBy(*keys)


def _stats_back(obs: DataFrame, **aggs: Column) -> DataFrame:
    """Series aggregates joined back to the rows: partial aggregates, then a small side that Spark may broadcast; no window that gathers a series."""
    stats = obs.groupBy(*[F.col(k).alias(f"__{k}") for k in SERIES]).agg(*[c.alias(k) for k, c in aggs.items()])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in SERIES])
    return obs.join(stats, on).drop(*[f"__{k}" for k in SERIES])


def zscore_departures(obs: DataFrame, limit: float = 3.0) -> DataFrame:
    z = guarded(F.col("value") - F.col("mean"), F.col("std"))
    df = _stats_back(obs, mean=F.avg("value"), std=F.stddev_samp("value")).withColumn("zscore", z)
    return df.withColumn("is_departure", F.coalesce(F.abs("zscore") > limit, F.lit(False))).select(*SERIES, "signal_0", "value", "zscore", "is_departure")


def mad_departures(obs: DataFrame) -> DataFrame:
    """Distance from the median in scaled MADs, in bands at 2, 2.5, 3.5 and 5."""
    mid = _stats_back(obs, median=F.percentile("value", F.lit(0.5))).withColumn("dev", F.abs(F.col("value") - F.col("median")))
    df = _stats_back(mid, mad=F.percentile("dev", F.lit(0.5))).withColumn("score", guarded(F.col("dev"), 1.4826 * F.col("mad")))
    s = F.col("score")
    band = F.when(s >= 5, "extreme").when(s >= 3.5, "severe").when(s >= 2.5, "moderate").when(s >= 2, "mild").otherwise("normal")
    return df.select(*SERIES, "signal_0", "value", "median", "mad", "score", band.alias("severity"))


def correlations(obs: DataFrame, least: int = 10) -> DataFrame:
    """Pearson correlation of each pair of signals of a cohort at equal coordinates."""
    b = obs.select(F.col("cohort").alias("c"), F.col("signal_id").alias("signal_b"), F.col("signal_0").alias("at"), F.col("value").alias("y"))
    a = obs.select("cohort", F.col("signal_id").alias("signal_a"), "signal_0", F.col("value").alias("x"))
    both = a.join(b, (F.col("cohort") == F.col("c")) & (F.col("signal_0") == F.col("at")) & (F.col("signal_a") < F.col("signal_b")))
    n = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, y = F.when(pair, F.col("x")), F.when(pair, F.col("y"))
    return both.groupBy("cohort", "signal_a", "signal_b").agg(n.alias("n"), guarded(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("correlation")).where(F.col("n") >= least)


def gaussian_fingerprint(windows: DataFrame, features: list[str]) -> DataFrame:
    """Mean and std of each feature over a series' windows, and their mean relative spread; features that are absent are null."""
    there = [f for f in features if f in windows.columns]
    aggs = []
    for f in features:
        c = F.col(f) if f in there else F.lit(None).cast("double")
        aggs += [F.avg(c).alias(f"mean_{f}"), F.stddev_samp(c).alias(f"std_{f}")]
    out = windows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_windows"), *aggs)
    ratios = [guarded(F.col(f"std_{f}"), F.abs(F.col(f"mean_{f}")), 1e-10) for f in there]
    known = reduce(Column.__add__, [r.isNotNull().cast("int") for r in ratios])
    return out.withColumn("fingerprint_volatility", guarded(reduce(Column.__add__, [F.coalesce(r, F.lit(0.0)) for r in ratios]), known))


def gaussian_similarity(prints: DataFrame, features: list[str]) -> DataFrame:
    """Bhattacharyya distance of two signals' Gaussian fingerprints within a cohort, averaged over features, and exp(-d)."""
    cols = [f"{k}_{f}" for f in features for k in ("mean", "std")]
    a = prints.select("cohort", F.col("signal_id").alias("signal_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = prints.select(F.col("cohort").alias("c"), F.col("signal_id").alias("signal_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = a.join(b, (F.col("cohort") == F.col("c")) & (F.col("signal_a") < F.col("signal_b")))

    def distance(f: str) -> Column:
        va, vb = F.col(f"a_std_{f}") ** 2, F.col(f"b_std_{f}") ** 2
        gap = (F.col(f"a_mean_{f}") - F.col(f"b_mean_{f}")) ** 2
        return F.when((va > 0) & (vb > 0), 0.25 * gap / (va + vb) + 0.5 * F.ln((va + vb) / (2 * F.sqrt(va * vb))))

    ds = [distance(f) for f in features]
    known = reduce(Column.__add__, [d.isNotNull().cast("int") for d in ds])
    total = reduce(Column.__add__, [F.coalesce(d, F.lit(0.0)) for d in ds])
    return both.select("cohort", "signal_a", "signal_b", known.alias("n_features"), guarded(total, known).alias("distance")).withColumn("similarity", F.exp(-F.col("distance")))


def normalize(obs: DataFrame, method: str = "zscore", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds center, scale and normalized: zscore (population), robust (IQR), mad (scaled), minmax to a range, or none."""
    unit = lambda c: F.when(c < 1e-10, F.lit(1.0)).otherwise(c)
    p = lambda c, q: F.percentile(c, F.lit(q))
    if method == "zscore":
        df = _stats_back(obs, center=F.avg("value"), scale=unit(F.stddev_pop("value")))
    elif method == "robust":
        df = _stats_back(obs, center=p("value", 0.5), scale=unit(p("value", 0.75) - p("value", 0.25)))
    elif method == "mad":
        mid = _stats_back(obs, center=p("value", 0.5)).withColumn("__d", F.abs(F.col("value") - F.col("center")))
        df = _stats_back(mid, scale=unit(1.4826 * p("__d", 0.5))).drop("__d")
    elif method == "minmax":
        df = _stats_back(obs, center=F.min("value"), scale=unit(F.max("value") - F.min("value")))
        return df.withColumn("normalized", (F.col("value") - F.col("center")) / F.col("scale") * (high - low) + low)
    elif method == "none":
        df = obs.withColumns({"center": F.lit(0.0), "scale": F.lit(1.0)})
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumn("normalized", (F.col("value") - F.col("center")) / F.col("scale"))


def denormalize(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("normalized") * F.col("scale") + F.col("center"))


def recommend(obs: DataFrame) -> DataFrame:
    """mad where over 5 % of a series are outliers or its kurtosis is over 10, robust for heavy tails or skew, else zscore."""
    p = lambda q: F.percentile("value", F.lit(q))
    df = _stats_back(obs, q1=p(0.25), q3=p(0.75), kurt=F.kurtosis("value"), skew=F.skewness("value"))
    r = 1.5 * (F.col("q3") - F.col("q1"))
    out = df.withColumn("__o", ((F.col("value") < F.col("q1") - r) | (F.col("value") > F.col("q3") + r)).cast("double"))
    agg = out.groupBy(*SERIES).agg(F.avg("__o").alias("outlier_share"), F.max("kurt").alias("kurtosis"), F.max("skew").alias("skewness"))
    pick = F.when((F.col("outlier_share") > 0.05) | (F.col("kurtosis") > 10), "mad").when((F.col("kurtosis") > 3) | (F.abs("skewness") > 1), "robust").otherwise("zscore")
    return agg.withColumn("method", pick)


def validate(obs: DataFrame) -> DataFrame:
    """One row: rows, nulls, non-finite values, signals, cohorts."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_not_finite"), F.countDistinct("signal_id").alias("n_signals"), F.countDistinct("cohort").alias("n_cohorts"))


def constant_signals(obs: DataFrame, least: float = 1e-10) -> DataFrame:
    return obs.groupBy(*SERIES).agg(F.count("value").alias("n"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std")).withColumn("is_constant", F.col("std") < least)


def without_constant(obs: DataFrame) -> DataFrame:
    return obs.join(constant_signals(obs).where("is_constant").select(*SERIES), SERIES, "left_anti")


def segments(obs: DataFrame, bounds: list[tuple[str, float, float | None]]) -> DataFrame:
    """Rows with the segments that they lie in, both ends included; an open end reaches to the last row."""
    tests = F.array_compact(F.array(*[F.when((F.col("signal_0") >= lo) & ((F.col("signal_0") <= hi) if hi is not None else F.lit(True)), F.lit(n)) for n, lo, hi in bounds]))
    return obs.select("*", F.explode(tests).alias("segment"))


def lifecycle(obs: DataFrame) -> DataFrame:
    """First, middle and last third of each series (the remainder goes to the middle)."""
    w = Window.partitionBy(*SERIES)
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("signal_0")) - 1
    third = F.floor(n / 3)
    return obs.withColumn("phase", F.when(rn < third, "early").when(rn >= n - third, "late").otherwise("mid"))
