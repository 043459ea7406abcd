"""Features of a metric's curve over the windows of a series: level, fit, thirds, velocity, acceleration, curvature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import guarded, r_squared

NAMES = ["mean", "std", "min", "max", "first", "last", "delta", "range", "spike_ratio", "slope", "r2", "early_mean", "mid_mean", "late_mean", "early_late_delta", "vel_mean", "vel_std", "vel_max", "vel_min", "vel_late_mean", "acc_mean", "acc_std", "acc_max", "acc_min", "curvature_mean"]


def curve_features(df: DataFrame, keys: list[str], order: str, metrics: list[str]) -> DataFrame:
    """A row for each key with the 25 features of each metric ({metric}_{feature}).

    NaN counts as null. Differences are between neighbouring rows, null where one is. Under 3 rows there is no velocity, under 4 no
    acceleration; under 3 values no fit. All windows share one partitioning and one order: one shuffle, one sort."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    df = df.select(*keys, order, *[F.when(~F.isnan(m), F.col(m).cast("double")).alias(m) for m in metrics])
    df = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(every)})
    df = df.withColumns({f"__v_{m}": F.col(m) - F.lag(m).over(w) for m in metrics})
    steps: dict[str, Column] = {}
    for m in metrics:
        steps |= {f"__a_{m}": F.col(f"__v_{m}") - F.lag(f"__v_{m}").over(w), f"__r_{m}": F.count(m).over(upto), f"__k_{m}": F.count(m).over(every), f"__s_{m}": F.count(f"__v_{m}").over(upto), f"__t_{m}": F.count(f"__v_{m}").over(every)}
    df = df.withColumns(steps)
    i, n = F.col("__i"), F.col("__n")
    third = F.greatest(F.lit(1), F.floor(n / 3))
    aggs = []
    for m in metrics:
        x, v, a = F.col(m), F.col(f"__v_{m}"), F.col(f"__a_{m}")
        head = F.avg(F.when(F.col(f"__r_{m}") <= F.greatest(F.lit(1), F.floor(F.col(f"__k_{m}") / 3)), x))
        first, last = F.max(F.when(i == 0, x)), F.max(F.when(i == n - 1, x))
        early, mid, late = F.avg(F.when(i < third, x)), F.avg(F.when((i >= third) & (i < 2 * third), x)), F.avg(F.when(i >= n - third, x))
        fit = F.count(x) >= 3
        at = F.when(x.isNotNull(), i.cast("double"))
        r2 = r_squared(x, at)
        many, more = F.max(n) >= 3, F.max(n) >= 4
        late_v = F.avg(F.when(F.col(f"__s_{m}") > F.col(f"__t_{m}") - F.greatest(F.lit(1), F.floor(F.col(f"__t_{m}") / 3)), v))
        kappa = F.abs(a) / F.pow(1 + v * v, 1.5)
        made = [
            F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), first, last, F.when(F.max(n) > 1, last - first), F.max(x) - F.min(x), guarded(F.max(x), head, 1e-10), F.when(fit, F.regr_slope(x, at)), F.when(fit, r2), early, mid, late, late - early,
            *[F.when(many, c) for c in (F.avg(v), F.stddev_pop(v), F.max(v), F.min(v), late_v)], *[F.when(more, c) for c in (F.avg(a), F.stddev_pop(a), F.max(a), F.min(a), F.avg(kappa))],
        ]
        aggs += [c.alias(f"{m}_{f}") for c, f in zip(made, NAMES)]
    return df.groupBy(*keys).agg(*aggs)


def curve_sql(table: str, keys: str, order: str, metrics: list[str]) -> str:
    """The same in SQL."""
    cols, steps, diffs = [], [], []
    for m in metrics:
        diffs.append(f"{m} - lag({m}) OVER w AS v_{m}")
        steps.append(f"v_{m} - lag(v_{m}) OVER w AS a_{m}, count({m}) OVER w AS r_{m}, count({m}) OVER e AS k_{m}, count(v_{m}) OVER w AS s_{m}, count(v_{m}) OVER e AS t_{m}")
        x, v, a = m, f"v_{m}", f"a_{m}"
        head = f"avg({x}) FILTER (r_{m} <= greatest(1, k_{m} // 3))"
        first, last = f"max({x}) FILTER (i = 0)", f"max({x}) FILTER (i = n - 1)"
        early, late = f"avg({x}) FILTER (i < third)", f"avg({x}) FILTER (i >= n - third)"
        made = [
            f"avg({x})", f"stddev_pop({x})", f"min({x})", f"max({x})", first, last, f"CASE WHEN max(n) > 1 THEN {last} - {first} END", f"max({x}) - min({x})", f"CASE WHEN abs({head}) > 1e-10 THEN max({x}) / {head} END",
            f"CASE WHEN count({x}) >= 3 THEN regr_slope({x}, i::DOUBLE) END", f"CASE WHEN count({x}) >= 3 THEN CASE WHEN var_pop({x}) > 0 THEN corr({x}, i::DOUBLE) ^ 2 ELSE 0 END END", early, f"avg({x}) FILTER (i >= third AND i < 2 * third)", late, f"{late} - {early}",
            *[f"CASE WHEN max(n) >= 3 THEN {c} END" for c in (f"avg({v})", f"stddev_pop({v})", f"max({v})", f"min({v})", f"avg({v}) FILTER (s_{m} > t_{m} - greatest(1, t_{m} // 3))")],
            *[f"CASE WHEN max(n) >= 4 THEN {c} END" for c in (f"avg({a})", f"stddev_pop({a})", f"max({a})", f"min({a})", f"avg(abs({a}) / (1 + {v} * {v}) ^ 1.5)")],
        ]
        cols += [f"CASE WHEN round({c}, 6) = 0 THEN 0 ELSE round({c}, 6) END AS {m}_{f}" for c, f in zip(made, NAMES)]
    named = f"SELECT *, row_number() OVER w - 1 AS i, count(*) OVER e AS n, greatest(1, count(*) OVER e // 3) AS third, {', '.join(diffs)} FROM ({table}) WINDOW w AS (PARTITION BY {keys} ORDER BY {order}), e AS (PARTITION BY {keys})"
    return f"SELECT {keys}, {', '.join(cols)} FROM (SELECT *, {', '.join(steps)} FROM ({named}) WINDOW w AS (PARTITION BY {keys} ORDER BY {order}), e AS (PARTITION BY {keys})) GROUP BY {keys}"
