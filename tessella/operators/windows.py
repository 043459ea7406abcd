"""Hopping count windows over series, as window expressions.

A window ends at row W-1 + k*S of its series and looks back W rows; a shorter series has none. Rows are numbered once and
grouped by window, so aggregates combine before the shuffle and no frame slides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["cohort", "signal_id"]


def ordered(keys: list[str] = SERIES):
    return Window.partitionBy(*keys).orderBy("signal_0")


def frame(width: int, keys: list[str] = SERIES):
    return ordered(keys).rowsBetween(-(width - 1), 0)


def assigned(obs: DataFrame, width: int, stride: int, keys: list[str] = SERIES, reach: int | None = None) -> DataFrame:
    """Each row once for each window that holds it (reach / stride copies): rn, n (the series' rows) and window_id.

    Grouping the copies by window costs O(rows * reach / stride) with partial aggregates, where a sliding frame would
    aggregate width rows anew for every row."""
    rn, n = F.row_number().over(ordered(keys)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = obs.select("*", rn.cast("long").alias("rn"), n.alias("n"))
    low = F.greatest(F.ceil((F.col("rn") - (width - 1)) / stride), F.lit(0))
    high = F.floor((F.col("rn") + (reach or width) - width) / stride)
    return df.withColumn("window_id", F.explode(F.when(high >= low, F.sequence(low, high))))  # rows between windows go


def _complete(df: DataFrame, width: int, partial: bool) -> DataFrame:
    """Whole windows only; partial: a series shorter than the window has one, window 0."""
    whole = F.col("__rows") == width
    return df.where(whole | ((F.col("__n") < width) & (F.col("window_id") == 0)) if partial else whole).drop("__rows", "__n")


def arrays(obs: DataFrame, width: int, stride: int, partial: bool = False, reach: int | None = None) -> DataFrame:
    """cohort, signal_id, window_id, signal_0_start, signal_0_end, signal_0_center, values (in order, nulls dropped).

    reach: values go back so many rows from the window's end, or to the start of the series."""
    reach = max(width, reach or width)
    df = assigned(obs, width, stride, reach=reach)
    inside = F.col("rn") >= F.col("window_id") * stride
    xs = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("rn", "value"))))
    g = df.groupBy(*SERIES, "window_id").agg(F.count_if(inside).alias("__rows"), F.max("n").alias("__n"), F.min(F.when(inside, F.col("signal_0"))).alias("signal_0_start"), F.max("signal_0").alias("signal_0_end"), xs.alias("xs"))
    out = _complete(g, width, partial)
    return out.select(*SERIES, "window_id", "signal_0_start", "signal_0_end", ((F.col("signal_0_start") + F.col("signal_0_end")) / 2).alias("signal_0_center"), F.col("xs.value").alias("values"))


def guarded(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b, null where |b| <= least: ANSI mode never sees the division."""
    return F.when(F.abs(b) > least, a / F.when(F.abs(b) > least, b))


def r_squared(y: Column, x: Column) -> Column:
    """Squared correlation as an aggregate over pairs (null in both or in none); 0 without spread, where corr() would divide by zero."""
    spread = F.var_pop(y) * F.var_pop(x)
    return F.when(spread > 0, guarded(F.pow(F.covar_pop(y, x), 2), spread)).when(F.count(y) > 0, 0.0)


def features(obs: DataFrame, width: int = 32, stride: int = 8) -> DataFrame:
    """Statistics of each window that need no array: moments, amplitude, trend, pulsation, change."""
    x, t = F.col("value"), F.col("rn").cast("double")
    df = assigned(obs.withColumn("__d", x - F.lag("value").over(ordered())), width, stride)
    d = F.when(F.col("rn") > F.col("window_id") * stride, F.col("__d"))
    top, low, rms = F.max(x), F.min(x), F.sqrt(F.avg(x * x))
    out = {
        "mean": F.avg(x), "std": F.stddev_pop(x), "kurtosis": F.kurtosis(x), "skewness": F.skewness(x), "rms": rms, "crest_factor": guarded(F.max(F.abs(x)), rms, 1e-15),
        "peak": F.max(F.abs(x)), "peak_to_peak": top - low, "pulsation_index": (top - low) / (F.abs(F.avg(x)) + 1e-10),
        "trend_slope": F.regr_slope(x, t), "trend_r2": F.regr_r2(x, t), "mean_rate": F.avg(d), "rate_std": F.stddev_pop(d), "abs_max_rate": F.max(F.abs(d)),
    }
    g = df.groupBy(*SERIES, "window_id").agg(F.count(F.lit(1)).alias("__rows"), F.max("n").alias("__n"), F.max("signal_0").alias("signal_0_end"), *[c.alias(k) for k, c in out.items()])
    return _complete(g, width, False)


def summarize(windows: DataFrame, metrics: list[str], threshold: float = 0.10) -> DataFrame:
    """Each metric's mean, std, cv and whether it varies, by series."""
    aggs = []
    for m in metrics:
        mean, std = F.avg(m), F.stddev_samp(m)
        cv = F.when(F.abs(mean) > 1e-10, guarded(std, F.abs(mean), 1e-10)).otherwise(std)
        aggs += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std"), cv.alias(f"{m}_cv"), (cv > threshold).alias(f"{m}_varies")]
    return windows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_windows"), *aggs)


def lookback(df: DataFrame, values: list[str], rows: int = 30, keys: list[str] = SERIES, order: str = "signal_0_end") -> DataFrame:
    """Means over the last rows (a shorter prefix at the start)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({f"{v}_lookback": F.avg(v).over(w) for v in values})


def gradient(value: Column, at: Column, w) -> Column:
    """Second-order differences on a non-uniform grid, one-sided at the ends."""
    f0, f1 = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = at - F.lag(at).over(w), F.lead(at).over(w) - at
    inner = guarded(hs * hs * f1 + (hd * hd - hs * hs) * value - hd * hd * f0, hs * hd * (hd + hs))
    return F.when(f0.isNull(), guarded(f1 - value, hd)).when(f1.isNull(), guarded(value - f0, hs)).otherwise(inner)


def tail(obs: DataFrame, n: int, keys: list[str] = SERIES) -> DataFrame:
    """The newest n points of each series."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("signal_0")))
    return obs.withColumn("__r", last).where(F.col("__r") <= n).drop("__r")
