"""Local exponents between cohorts: a grid around each line between neighbouring cohorts' centroids, ridges over it, basins around them.

Positions are the first eigenvalues of a cohort's geometry. Grid points are few (at most three neighbours a cohort), points of
trajectories many: each task finds the nearest of its own rows to every grid point, and the nearest of those are taken by key."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAREST, GRID, LEAST_COHORTS = 10, 20, 10
#: Rows of a part, and asked points whose distances to them are held at once.
PART, BLOCK = 4096, 256


def _moves(geometry: DataFrame, dims: list[str]) -> DataFrame:
    """engine, cohort, p (position) and q (the cohort's next position, null at its end)."""
    at = F.array(*[F.col(c).cast("double") for c in dims])
    w = Window.partitionBy("engine", "cohort").orderBy("signal_0_end")
    return geometry.select("engine", "cohort", "signal_0_end", at.alias("p")).withColumn("q", F.lead("p").over(w))


def _centroids(geometry: DataFrame, dims: list[str]) -> DataFrame:
    """engine, cohort and the mean position of cohorts whose positions are all finite; engines of under ten such cohorts go."""
    fine = reduce(Column.__and__, [F.col(c).isNotNull() & (F.abs(c) < float("inf")) for c in dims])
    g = geometry.groupBy("engine", "cohort").agg(F.min(F.coalesce(fine, F.lit(False))).alias("ok"), F.array(*[F.avg(c) for c in dims]).alias("c")).where("ok").drop("ok")
    return g.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("engine"))).where(F.col("__n") >= LEAST_COHORTS).drop("__n")


def neighbours(points: np.ndarray, nearest: int = 3) -> list[tuple[int, int]]:
    """Pairs of neighbours: edges of the Delaunay triangulation of the first two dimensions, found by empty circumcircles.

    Points on one line, and points of one dimension, pair with their nearest instead."""
    n = len(points)
    if n < 3:
        return [(0, 1)] if n == 2 else []
    if points.shape[1] >= 2:
        found = _triangulated(points[:, :2])
        if found:
            return found
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : nearest + 1]
    return sorted({(min(i, int(j)), max(i, int(j))) for i in range(n) for j in near[i]})


def _triangulated(p: np.ndarray) -> list[tuple[int, int]]:
    """Incremental: the triangles whose circle holds a new point make room for a fan around it."""
    span = float(np.ptp(p, axis=0).max())
    if span < 1e-12:
        return []
    x = (p - p.mean(0)) / span
    n = len(x)
    x = np.vstack([x, [[-1e4, -1e4], [1e4, -1e4], [0, 1e4]]])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = x[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-300:
            return None
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        u = np.array([(a * (by - cy) + b * (cy - ay) + c * (ay - by)) / d, (a * (cx - bx) + b * (ax - cx) + c * (bx - ax)) / d])
        return u, float(((x[t[0]] - u) ** 2).sum())

    triangles = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, c in triangles.items() if c and ((x[i] - c[0]) ** 2).sum() < c[1]]
        rim: dict[tuple[int, int], int] = {}
        for t in bad:
            del triangles[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                key = (min(e), max(e))
                rim[key] = rim.get(key, 0) + 1
        for (a, b), times in rim.items():
            if times == 1:
                t = (a, b, i)
                triangles[t] = circle(t)
    inner = [t for t, c in triangles.items() if c and max(t) < n]
    return sorted({(min(a, b), max(a, b)) for t in inner for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))})


def grid(a: np.ndarray, b: np.ndarray, points: int = GRID, reach: float = 2.0) -> np.ndarray:
    """Points along the line through a and b, as long as reach times their distance, and to its sides."""
    mid, axis = (a + b) / 2, b - a
    length = np.linalg.norm(axis)
    if length < 1e-10:
        return mid[None]
    unit = axis / length
    along = np.linspace(-0.5 * reach, 0.5 * reach, points)
    if len(a) < 2:
        return mid + along[:, None] * length * unit
    side = np.eye(len(a))[0 if abs(unit[0]) < 0.9 else 1]
    side = side - side @ unit * unit
    side /= np.linalg.norm(side)
    across = np.linspace(-0.3, 0.3, max(3, points // 4))
    return (mid + along[:, None, None] * length * unit + across[None, :, None] * length * side).reshape(-1, len(a))


def strain(now: np.ndarray, later: np.ndarray) -> float:
    """Logarithm of the greatest stretch of the linear map that takes a cloud to where it is a step later; 0 for under three points."""
    if len(now) < 3:
        return 0.0
    a, b = now - now.mean(0), later - later.mean(0)
    if np.linalg.norm(a) < 1e-12:
        return 0.0
    f = np.linalg.lstsq(a, b, rcond=None)[0]
    return float(np.log(np.sqrt(max(np.linalg.eigvalsh(f.T @ f).max(), 1e-12))))


def _exponents(asked: DataFrame, moves: DataFrame) -> DataFrame:
    """engine, id, place and the exponent at each asked point x: from its ten nearest rows of the engine, those that have a next row.

    Asked points of an engine (a bounded set, stated above) meet each part of its rows; a part gives ten rows a point at most."""
    sides = asked.groupBy("engine").agg(F.collect_list(F.struct("id", "place", "x")).alias("asked"))
    sizes = moves.groupBy("engine").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    parts = moves.join(sizes, "engine").withColumn("part", F.pmod(F.xxhash64("cohort", "signal_0_end"), F.col("parts"))).groupBy("engine", "part").agg(F.array_sort(F.collect_list(F.struct("cohort", "signal_0_end", "p", "q"))).alias("rows"))

    def nearest(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                p = np.array([[np.nan if v is None else v for v in t["p"]] for t in r.rows], float)
                x = np.array([list(one["x"]) for one in r.asked], float)
                for first in range(0, len(x), BLOCK):
                    d = np.sqrt(((x[first : first + BLOCK, None] - p[None]) ** 2).sum(2))
                    near = np.argsort(d, axis=1, kind="stable")[:, :NEAREST]
                    for i, at in enumerate(near):
                        one = r.asked[first + i]
                        out += [(r.engine, one["id"], one["place"], float(d[i, j]), r.rows[j]["cohort"], r.rows[j]["signal_0_end"], r.rows[j]["p"], r.rows[j]["q"]) for j in at if d[i, j] == d[i, j]]
            yield pd.DataFrame(out, columns=["engine", "id", "place", "d", "cohort", "t", "p", "q"])

    found = parts.join(sides, "engine").mapInPandas(nearest, "engine string, id string, place int, d double, cohort string, t double, p array<double>, q array<double>")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "cohort", "t", "p", "q"))), 1, NEAREST)
    held = found.groupBy("engine", "id", "place").agg(best.alias("near"))

    def exponent(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                both = [t for t in r.near if t["q"] is not None]
                enough = len(r.near) >= 3 and both
                out.append((r.engine, r.id, r.place, strain(np.array([t["p"] for t in both], float), np.array([t["q"] for t in both], float)) if enough else 0.0))
            yield pd.DataFrame(out, columns=["engine", "id", "place", "ftle"])

    return held.mapInPandas(exponent, "engine string, id string, place int, ftle double")


def _dims(geometry: DataFrame) -> list[str]:
    return [c for c in geometry.columns if c.startswith("eigenvalue_")][:3]


def _per_engine(centroids: DataFrame, of, schema: str) -> DataFrame:
    """of(cohorts, positions) -> rows; an engine's centroids are one row a cohort."""
    packed = centroids.groupBy("engine").agg(F.array_sort(F.collect_list(F.struct("cohort", "c"))).alias("cs"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(r.engine, *x) for r in pdf.itertuples() for x in of([c["cohort"] for c in r.cs], np.array([list(c["c"]) for c in r.cs], float))]
            yield pd.DataFrame(rows, columns=["engine", *names])

    return packed.mapInPandas(run, "engine string, " + schema)


def ftle_field(geometry: DataFrame, points: int = GRID, reach: float = 2.0) -> DataFrame:
    """By pair of neighbouring cohorts: where the exponent is greatest on the grid between them, how strong and wide that ridge is,
    and which share of the grid lies well under it. Engines of under ten cohorts, and pairs without an exponent, have no rows."""
    dims = _dims(geometry)

    def between(cohorts, at):
        for i, j in neighbours(at):
            length = float(np.linalg.norm(at[j] - at[i]))
            unit = (at[j] - at[i]) / length if length > 0 else at[j] - at[i]
            for n, x in enumerate(grid(at[i], at[j], points, reach)):
                yield f"{i}-{j}", n, cohorts[i], cohorts[j], length, float(x @ unit), x.tolist()

    asked = _per_engine(_centroids(geometry, dims), between, "id string, place int, centroid_a string, centroid_b string, inter_centroid_distance double, along double, x array<double>")
    made = asked.join(_exponents(asked.select("engine", "id", "place", "x"), _moves(geometry, dims)), ["engine", "id", "place"])
    keys = ["engine", "id", "centroid_a", "centroid_b", "inter_centroid_distance"]
    top = F.max("ftle").over(Window.partitionBy("engine", "id"))
    high = F.when(F.col("ftle") >= F.col("top") / 2, F.col("along"))
    live = F.col("ftle") != 0
    g = made.withColumn("top", top).groupBy(*keys).agg(F.count_if(live).alias("__live"), F.max("top").alias("ridge_strength"), F.min_by("x", F.when(live, F.struct(-F.col("ftle"), "place"))).alias("ridge_location"), F.when(F.count(high) > 1, F.max(high) - F.min(high)).otherwise(0.0).alias("ridge_width"), (F.count_if(F.col("ftle") < F.col("top") * 0.3) / F.count(F.lit(1))).alias("corridor_width"))
    return g.where("__live > 0").drop("__live", "id")


def basins(geometry: DataFrame, around: int = 8) -> DataFrame:
    """By cohort: the mean exponent on three rings about its centroid (half, one and one and a half times the distance that a quarter
    of the engine's rows lie within), that distance, and the neighbour behind its weakest ridge."""
    dims = _dims(geometry)
    c, moves = _centroids(geometry, dims), _moves(geometry, dims)
    far = F.sqrt(F.aggregate(F.zip_with("p", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    radius = c.join(moves.select("engine", "p"), "engine").withColumn("d", far).groupBy("engine", "cohort").agg(F.first("c").alias("c"), F.percentile("d", 0.25).alias("radius"))

    def rings(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                at = np.array(list(r.c), float)
                for n, (angle, part) in enumerate((a, p) for a in np.linspace(0, 2 * np.pi, around, endpoint=False) for p in (0.5, 1.0, 1.5)):
                    off = np.zeros(len(at))
                    off[: min(2, len(at))] = (np.cos(angle), np.sin(angle)) if len(at) >= 2 else (1.0,)
                    out.append((r.engine, r.cohort, n, float(r.radius), (at + part * r.radius * off).tolist()))
            yield pd.DataFrame(out, columns=["engine", "id", "place", "basin_radius", "x"])

    asked = radius.mapInPandas(rings, "engine string, id string, place int, basin_radius double, x array<double>")
    depth = asked.join(_exponents(asked.select("engine", "id", "place", "x"), moves), ["engine", "id", "place"]).groupBy("engine", "id").agg(F.avg(F.when(F.col("ftle") != 0, F.col("ftle"))).alias("basin_depth"), F.max("basin_radius").alias("basin_radius"))
    ridges = ftle_field(geometry)
    ends = ridges.select("engine", F.explode(F.array(F.struct(F.col("centroid_a").alias("id"), F.col("centroid_b").alias("other")), F.struct(F.col("centroid_b").alias("id"), F.col("centroid_a").alias("other")))).alias("e"), "ridge_strength").select("engine", "e.*", "ridge_strength")
    out = ends.groupBy("engine", "id").agg(F.min_by("other", F.struct("ridge_strength", "other")).alias("escape_direction"), F.count(F.lit(1)).alias("n_corridors"))
    return depth.join(out, ["engine", "id"], "left").select("engine", F.col("id").alias("centroid_id"), "basin_depth", "basin_radius", "escape_direction", F.coalesce("n_corridors", F.lit(0)).alias("n_corridors"))
