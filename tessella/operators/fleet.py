"""Pairs of signals within a window, and cohorts as members of a fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import AT, cohort_geometry, dominance
from .windows import guarded


def _sum(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms, F.lit(0.0))


def vector_pairs(rows: DataFrame, keys: list[str], name: str, features: list[str], floor: float = 1e-12) -> DataFrame:
    """Distance, cosine and correlation of the feature vectors of each two members (column name) with equal keys.

    Members with a feature that is not finite are left out. A pair is made within a key's few members only."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    whole = reduce(Column.__and__, [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) for f in features])
    ok = rows.where(whole).select(*keys, name, vector.alias("x"))
    a = ok.select(*keys, F.col(name).alias(f"{name}_a"), F.col("x").alias("xa"))
    b = ok.select(*keys, F.col(name).alias(f"{name}_b"), F.col("x").alias("xb"))
    j = a.join(b, keys).where(F.col(f"{name}_a") < F.col(f"{name}_b"))
    at = lambda c, i: F.get(c, F.lit(i))
    n = len(features)
    dot = lambda p, q: _sum([p(i) * q(i) for i in range(n)])
    xa, xb = (lambda i: at("xa", i)), (lambda i: at("xb", i))
    ma, mb = (_sum([x(i) for i in range(n)]) / n for x in (xa, xb))
    ca, cb = (lambda i: xa(i) - F.col("ma")), (lambda i: xb(i) - F.col("mb"))
    gap = F.sqrt(_sum([(xa(i) - xb(i)) ** 2 for i in range(n)]))
    j = j.withColumns({"ma": ma, "mb": mb})
    cosine = guarded(dot(xa, xb), F.sqrt(dot(xa, xa)) * F.sqrt(dot(xb, xb)), floor)
    correlation = guarded(dot(ca, cb), F.sqrt(dot(ca, ca)) * F.sqrt(dot(cb, cb)), floor)
    return j.withColumns({"distance": gap, "cosine_similarity": cosine, "correlation": correlation}).drop("ma", "mb", "xa", "xb")


def signal_pairwise(windows: DataFrame, features: list[str], loadings: DataFrame | None = None, threshold: float = 0.1) -> DataFrame:
    """Each two signals of a window: their vectors' distance, cosine and correlation (0 where a vector is constant), where both lie
    about the window's centroid, and whether their loadings on the first component ask for causality.

    loadings: cohort, signal_0_end, signal_id, pc1_loading (absent: 0)."""
    w = Window.partitionBy(*AT)
    centre = windows.withColumns({f"__c_{f}": F.avg(f).over(w) for f in features})
    d = F.sqrt(_sum([(F.col(f) - F.col(f"__c_{f}")) ** 2 for f in features]))
    norm = F.sqrt(_sum([F.col(f"__c_{f}") ** 2 for f in features]))
    side = F.coalesce(guarded(_sum([F.col(f) * F.col(f"__c_{f}") for f in features]), norm, 1e-12), F.lit(0.0))
    about = centre.select(*AT, "signal_id", d.alias("d"), side.alias("side")).withColumn("mean_d", F.avg("d").over(w))
    if loadings is not None:
        about = about.join(loadings.select(*AT, "signal_id", F.col("pc1_loading").alias("load")), [*AT, "signal_id"], "left")
    else:
        about = about.withColumn("load", F.lit(0.0))
    out = vector_pairs(windows, AT, "signal_id", features).withColumnsRenamed({"signal_id_a": "signal_a", "signal_id_b": "signal_b"})
    for s in "ab":
        out = out.join(about.select(*AT, F.col("signal_id").alias(f"signal_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("d", "side", "mean_d", "load")]), [*AT, f"signal_{s}"])
    co = F.abs(F.coalesce("load_a", F.lit(0.0)) * F.coalesce("load_b", F.lit(0.0)))
    close, far = ((F.col("d_a") < F.col("mean_d_a")) & (F.col("d_b") < F.col("mean_d_a"))), ((F.col("d_a") > F.col("mean_d_a")) & (F.col("d_b") > F.col("mean_d_a")))
    return out.select(
        *AT, "signal_a", "signal_b", "distance", "cosine_similarity", F.coalesce("correlation", F.lit(0.0)).alias("correlation"), close.alias("both_close_to_state"), far.alias("both_far_from_state"),
        (F.col("side_a") * F.col("side_b") > 0).alias("same_side_of_state"), F.abs(F.col("d_a") - F.col("d_b")).alias("state_distance_diff"), co.alias("pc1_coloading"), (co > threshold).alias("needs_granger"),
    )


def cohort_pairwise(vectors: DataFrame, features: list[str], loadings: DataFrame | None = None, threshold: float = 0.3) -> DataFrame:
    """Each two cohorts at a window end, by their vectors; causality is asked for where loadings do not say otherwise.

    loadings: signal_0_end, cohort, pc1_loading."""
    out = vector_pairs(vectors, ["signal_0_end"], "cohort", features)
    if loadings is None:
        return out.withColumns({"pc1_coloading": F.lit(None).cast("double"), "needs_granger": F.lit(True)})
    for s in "ab":
        out = out.join(loadings.select("signal_0_end", F.col("cohort").alias(f"cohort_{s}"), F.col("pc1_loading").alias(f"load_{s}")), ["signal_0_end", f"cohort_{s}"], "left")
    co = F.col("load_a") * F.col("load_b")
    return out.withColumns({"pc1_coloading": co, "needs_granger": F.coalesce(F.abs(co) > threshold, F.lit(True))}).drop("load_a", "load_b")


def system_geometry(vectors: DataFrame, features: list[str]) -> DataFrame:
    """Spectrum of the cohorts' vectors at each window end, where there are more cohorts than features; columns as cohort_geometry."""
    enough = F.count(F.lit(1)).over(Window.partitionBy("signal_0_end")) > len(features)
    members = vectors.withColumn("__n", enough).where("__n").select(F.lit("fleet").alias("cohort"), F.col("cohort").alias("signal_id"), "signal_0_end", *features)
    return cohort_geometry(members, {"system": features})


def fleet_observations(vectors: DataFrame, value: str) -> DataFrame:
    """Cohorts as the signals of one fleet, a value of theirs over window ends: what the series operators read."""
    return vectors.select(F.lit("fleet").alias("cohort"), F.col("cohort").alias("signal_id"), F.col("signal_0_end").alias("signal_0"), F.col(value).cast("double").alias("value"))


def dominance_with_total(positions: DataFrame) -> DataFrame:
    """Dominance by engine, and over all engines together (engine `all`)."""
    return dominance(positions).unionByName(dominance(positions.withColumn("engine", F.lit("all"))))
