"""Features of trajectories through geometry: signatures, one axis of order, disagreement of sub-windows, several axes side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import guarded

#: The metrics of a signature, and those of them that are weighted by position.
METRICS = ["effective_dim", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "total_variance", "condition_number", "speed", "curvature", "acceleration_magnitude", "effective_dim_velocity", "effective_dim_acceleration", "effective_dim_curvature"]
WEIGHTED = {"curvature": "curvature", "speed": "speed", "effective_dim": "eff_dim", "condition_number": "cond_num"}
AT = ["cohort", "signal_0_end"]


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _sum(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms)


def _engine(df: DataFrame, engine: str) -> DataFrame:
    """Rows of the engine, or of the one with most rows where there is none of it."""
    best = df.groupBy("engine").count().orderBy((F.col("engine") != engine), F.desc("count"), "engine").limit(1)  # a row for each engine
    return df.join(best.select("engine"), "engine", "left_semi").drop("engine")


def signatures(geometry: DataFrame, dynamics: DataFrame, field: DataFrame, engine: str = "shape") -> DataFrame:
    """Geometry, its motion and the velocity field by (cohort, signal_0_end), and the length of the way so far.

    The way runs through all columns, a gap counting as 0."""
    g, d = _engine(geometry, engine), _engine(dynamics, engine)
    own = [c for c in METRICS[:6] if c in g.columns]
    moved = d.select(*AT, *[F.col(c).alias(f"effective_dim_{c}") for c in ("velocity", "acceleration", "curvature") if c in d.columns])
    flow = field.select(*AT, *[c for c in ("speed", "curvature", "acceleration_magnitude") if c in field.columns])
    j = g.select(*AT, *own).join(moved, AT).join(flow, AT)
    w = Window.partitionBy("cohort").orderBy("signal_0_end")
    cols = [c for c in j.columns if c not in AT]
    zero = {c: F.coalesce(_number(c), F.lit(0.0)) for c in cols}
    step = F.sqrt(_sum([(zero[c] - F.lag(zero[c]).over(w)) ** 2 for c in cols]))
    return j.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn("arc_length", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def _squared_from(middle: Column):
    return lambda x: (x - middle) * (x - middle)


def _placed(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("cohort")
    return df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)}).withColumn("__third", F.floor(F.col("__n") / 3))


def _early(c: str) -> Column:
    return F.avg(F.when(F.col("__i") < F.col("__third"), F.col(c)))


def _late(c: str) -> Column:
    return F.avg(F.when(F.col("__i") >= F.col("__n") - F.col("__third"), F.col(c)))


def _slope(c: str) -> Column:
    at = F.when(F.col(c).isNotNull(), F.col("__i").cast("double"))
    return F.when(F.count(c) >= 3, F.regr_slope(F.col(c), at))


def axis_features(signature: DataFrame, axis: str) -> DataFrame:
    """One row a cohort, names led by the axis: number of windows, length of the way, and of each metric the mean, spread, extremes,
    first and last third, slope and values at quarters of the way; then means weighted by the squared position, and how curvature
    and condition rise.

    Thirds and slopes need four windows and four numbers, quarters three numbers. Where the way has no length, positions are even."""
    names = [m for m in METRICS if m in signature.columns]
    df = _placed(signature.select("cohort", "signal_0_end", "arc_length", *[_number(m).alias(m) for m in names]), "signal_0_end")
    whole = F.max("arc_length").over(Window.partitionBy("cohort"))
    even = F.when(F.col("__n") > 1, F.col("__i") / F.when(F.col("__n") > 1, F.col("__n") - 1)).otherwise(0.0)
    df = df.withColumn("__whole", whole).withColumn("__pos", F.when(F.col("__whole") > 0, guarded(F.col("arc_length"), F.col("__whole"))).otherwise(even))
    aggs = [F.count(F.lit(1)).alias("n_windows"), F.max("arc_length").alias("arc_length_total")]
    n = F.max("__n")
    for m in names:
        some = (n >= 4) & (F.count(m) >= 4)
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
        aggs += [F.when(some, _early(m)).alias(f"{m}_early"), F.when(some, _late(m)).alias(f"{m}_late"), F.when(some, _slope(m)).alias(f"{m}_slope"), F.count(m).alias(f"__{m}_count")]
        point = F.struct(F.col("__pos").alias("p"), F.col(m).alias("v"))
        for q in (1, 2, 3):
            known = F.col(m).isNotNull()
            aggs += [F.max_by(point, F.when(known & (F.col("__pos") <= q / 4), F.col("__i"))).alias(f"__{m}_a{q}"), F.min_by(point, F.when(known & (F.col("__pos") > q / 4), F.col("__i"))).alias(f"__{m}_b{q}")]
    weight = F.col("__pos") ** 2
    for m, short in WEIGHTED.items():
        if m in names and "curvature" in names:
            aggs.append(guarded(F.coalesce(F.sum(F.col(m) * weight), F.lit(0.0)), F.sum(F.when(F.col("curvature").isNotNull(), weight))).alias(f"{short}_pos_weighted"))
    if {"curvature", "speed"} <= set(names):
        late = F.col("__i") >= F.col("__n") - F.greatest(F.lit(1), F.col("__third"))
        enough = (n >= 3) & (F.count("curvature") >= 3)
        aggs += [F.when(enough, _slope("curvature")).alias("curvature_trend"), F.when(enough, F.avg(F.when(late, F.col("curvature") * F.col("speed")))).alias("curvature_speed_product_late")]
    if "condition_number" in names:
        aggs.append(F.when(n >= 4, guarded(F.max("condition_number"), _early("condition_number"))).alias("cond_spike_ratio"))
    g = df.groupBy("cohort").agg(*aggs)
    out = [c for c in g.columns if c != "cohort" and not c.startswith("__")]
    made = {c: F.col(c) for c in out}
    for m in names:
        early, late = F.col(f"{m}_early"), F.col(f"{m}_late")
        made |= {f"{m}_range": F.col(f"{m}_max") - F.col(f"{m}_min"), f"{m}_early": F.when(late.isNotNull(), early), f"{m}_late": F.when(early.isNotNull(), late), f"{m}_delta": late - early}
        for q in (1, 2, 3):
            a, b = F.col(f"__{m}_a{q}"), F.col(f"__{m}_b{q}")
            between = a["v"] + guarded((b["v"] - a["v"]) * (q / 4 - a["p"]), b["p"] - a["p"])
            made[f"{m}_q{q}"] = F.when(F.col(f"__{m}_count") >= 3, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between))
    return g.select("cohort", *[v.alias(f"{axis}_{c}") for c, v in made.items()])


def subwindow_features(geometry: DataFrame, axis: str) -> DataFrame:
    """How far the feature groups of a window disagree, by cohort: least dimension, largest condition, their spread over the groups,
    and groups that are degenerate (condition over 100). First and last third and slopes need four windows."""
    dim, cond = _number("effective_dim"), _number("condition_number")
    w = geometry.groupBy(*AT).agg(F.min(dim).alias("eff_dim_min"), (F.max(dim) - F.min(dim)).alias("eff_dim_spread"), F.max(cond).alias("cond_max"), (F.max(cond) - F.min(cond)).alias("cond_spread"), F.count_if(cond > 100).alias("degenerate"), F.count(F.lit(1)).alias("rows"))
    df, four = _placed(w, "signal_0_end"), F.max("__n") >= 4
    aggs = [F.avg("eff_dim_min").alias("eff_dim_min_mean"), F.min("eff_dim_min").alias("eff_dim_min_min"), F.avg("cond_max").alias("cond_max_mean"), F.max("cond_max").alias("cond_max_max")]
    aggs += [f(c).alias(f"{c}_{n}") for c in ("eff_dim_spread", "cond_spread") for n, f in (("mean", F.avg), ("max", F.max))]
    aggs += [F.sum("degenerate").alias("n_degenerate"), (F.sum("degenerate") / F.sum("rows")).alias("frac_degenerate")]
    for c in ("eff_dim_min", "cond_max"):
        aggs += [F.when(four, _early(c)).alias(f"{c}_early"), F.when(four, _late(c)).alias(f"{c}_late"), F.when(four, _late(c) - _early(c)).alias(f"{c}_delta")]
    aggs += [F.when(four, _slope(c)).alias(f"{c}_slope") for c in ("eff_dim_min", "eff_dim_spread")]
    g = df.groupBy("cohort").agg(*aggs)
    return g.select("cohort", *[F.col(c).alias(f"{axis}_sw_{c}") for c in g.columns if c != "cohort"])


def with_match(features: DataFrame, match: DataFrame, axis: str) -> DataFrame:
    """Features with what the cohort's trajectory was matched to (the columns of match that there are)."""
    held = [c for c in ("trajectory_id", "match_distance", "match_confidence", "trajectory_position") if c in match.columns]
    return features.join(match.select("cohort", *[F.col(c).alias(f"{axis}_{c}") for c in held]), "cohort", "left")


def cross_axis_features(axes: dict[str, DataFrame], collapse: float = -0.15) -> DataFrame:
    """All axes' features side by side, and whether they agree: how many collapse (change of dimension under the limit), how their
    changes, late conditions and late dimensions spread, and whether they match one trajectory (these from two axes on)."""
    j = reduce(lambda a, b: a.join(b, "cohort", "full"), axes.values())

    def of(suffix: str) -> Column:
        cols = [_number(f"{a}_{suffix}").cast("double") for a in axes if f"{a}_{suffix}" in j.columns]
        return F.array_compact(F.array(*cols)) if cols else F.expr("cast(array() as array<double>)")

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    df = j.withColumns({"__d": of("effective_dim_delta"), "__c": of("condition_number_late"), "__e": of("effective_dim_late")})
    ids = [F.col(f"{a}_trajectory_id") for a in axes if f"{a}_trajectory_id" in j.columns]
    df = df.withColumn("__t", F.array_compact(F.array(*[c.cast("long") for c in ids])) if ids else F.expr("cast(array() as array<bigint>)"))
    mean = lambda c: total(F.col(c)) / F.when(F.size(c) > 0, F.size(c))
    down = F.size(F.filter("__d", lambda x: x < collapse))
    out = {"n_axes_collapsing": down, "collapse_on_any": (down > 0).cast("int"), "collapse_on_all": (down == len(axes)).cast("int"), "min_dim_delta": F.array_min("__d"), "max_dim_delta": F.array_max("__d"), "mean_dim_delta": mean("__d"), "dim_delta_spread": F.array_max("__d") - F.array_min("__d")}
    for c, name, end, f in (("__c", "cond_late", "max", F.array_max), ("__e", "dim_late", "min", F.array_min)):
        two = F.size(c) >= 2
        middle = mean(c)
        spread = F.sqrt(total(F.transform(c, _squared_from(middle))) / F.when(two, F.size(c)))
        out |= {f"{name}_mean": F.when(two, mean(c)), f"{name}_{end}": F.when(two, f(c)), f"{name}_std": F.when(two, spread)}
    kinds, two = F.size(F.array_distinct("__t")), F.size("__t") >= 2
    out |= {"trajectory_agreement": F.when(two, (kinds == 1).cast("int")), "n_distinct_trajectories": F.when(two, kinds)}
    return df.select("cohort", *[v.alias(f"cross_{c}") for c, v in out.items()], *[c for c in j.columns if c != "cohort"])
