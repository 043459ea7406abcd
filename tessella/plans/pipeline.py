"""The stages of a run as a graph of named outputs, and the command line.

    python -m tessella.plans.pipeline DATA_DIR [--stages a,b] [--skip c] [-q]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import axes, field, fleet, geometry, grouped, state, windows
from ..sources.tables import Catalog, load_observations
from . import config

#: Stages of several cohorts.
FLEET = {"cohort_pairwise", "system_geometry", "trajectory_library"}
_FEATURES = ["rms", "rate_std", "peak"]
_VECTOR = ["shape_effective_dim", "change_effective_dim"]


def _stages(obs: DataFrame, manifest: dict) -> dict[str, tuple[list[str], Callable[..., DataFrame]]]:
    """name -> (names of the outputs it reads, function of them)."""
    size = manifest.get("system", {})
    width, stride = size.get("window", 128), size.get("stride", 64)
    return {
        "breaks": ([], lambda: grouped.breaks(obs)),
        "signal_vector": ([], lambda: windows.features(obs, width, stride)),
        "cohort_vector": (["signal_vector"], lambda w: geometry.centroid(w, _FEATURES)),
        "cohort_geometry": (["signal_vector"], geometry.cohort_geometry),
        "signal_geometry": (["signal_vector"], lambda w: geometry.signal_geometry(w, _FEATURES)),
        "signal_pairwise": (["signal_vector"], lambda w: fleet.signal_pairwise(w, _FEATURES)),
        "signal_dominance": (["cohort_geometry"], lambda g: fleet.dominance_with_total(geometry.signal_positions(g))),
        "geometry_dynamics": (["cohort_geometry"], geometry.dynamics),
        "thermodynamics": (["cohort_geometry"], geometry.thermodynamics),
        "ftle": ([], lambda: grouped.ftle_both(obs)),
        "ftle_rolling": ([], lambda: grouped.ftle_rolling(obs)),
        "velocity_field": ([], lambda: geometry.velocity_field(obs)),
        "ridge_proximity": (["ftle_rolling", "velocity_field"], grouped.ridge_proximity),
        "critical_slowing_down": ([], lambda: grouped.slowing_down(obs)),
        "cohort_baseline": ([], lambda: geometry.baseline(obs)),
        "observation_geometry": (["cohort_baseline"], lambda b: geometry.observation_scores(obs, b)),
        "fingerprint": ([], lambda: grouped.fingerprint(obs)),
        "sensor_eigendecomp": ([], lambda: state.sensor_eigen(obs)),
        "signal_stability": ([], lambda: state.signal_stability(obs)),
        "segment_comparison": ([], lambda: state.segment_comparison(obs, config.segments(manifest))),
        "baseline_spectrum": ([], lambda: state.baseline_spectrum(obs)),
        "baseline_scores": (["baseline_spectrum"], lambda b: state.baseline_scores(obs, b)),
        "ftle_field": (["cohort_geometry"], field.ftle_field),
        "trajectory_signatures": (["cohort_geometry", "geometry_dynamics", "velocity_field"], axes.signatures),
        "axis_features": (["trajectory_signatures"], lambda t: axes.axis_features(t, "time")),
        "subwindow_features": (["cohort_geometry"], lambda g: axes.subwindow_features(g, "time")),
        "system_vector": (["cohort_geometry"], geometry.wide),
        "system_geometry": (["system_vector"], lambda v: fleet.system_geometry(v, _VECTOR)),
        "cohort_pairwise": (["system_vector"], lambda v: fleet.cohort_pairwise(v, _VECTOR)),
        "trajectory_library": (["system_vector"], lambda v: grouped.trajectory_library(v, "signal_0_end", _VECTOR)),
    }


def run(spark: SparkSession, data_dir: str, manifest: dict | None = None, stages: list[str] | None = None, skip: list[str] = (), quiet: bool = True) -> list[str]:
    """Write each stage's output below the output folder, in order; what stages do not make is read from there. Returns the stages that ran.

    Unknown names and inputs that no run has made raise ValueError. Fleet stages need two cohorts unless the manifest forces them."""
    manifest = manifest or {"_data_dir": data_dir}
    obs = load_observations(spark, config.observations_path(manifest))
    out, graph, done = Catalog(spark, config.output_path(manifest)), _stages(obs, manifest), []
    unknown = sorted({*(stages or []), *skip} - set(graph))
    if unknown:
        raise ValueError(f"no such stages: {', '.join(unknown)}")
    without = set(skip) | (FLEET if config.skips_fleet(manifest, obs.select("cohort").distinct().count()) else set())
    for name, (needs, make) in graph.items():
        if name in without or stages and name not in stages:
            continue
        inputs = [out.read(n) for n in needs]
        if None in inputs:
            raise ValueError(f"{name} needs {needs[inputs.index(None)]}")
        out.write(make(*inputs), name)
        done.append(name)
        if not quiet:
            print(name)
    return done


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Run the stages over DATA_DIR/manifest.yaml, or over DATA_DIR/observations.parquet alone.")
    p.add_argument("data_dir")
    p.add_argument("--stages", type=lambda x: x.split(","))
    p.add_argument("--skip", type=lambda x: x.split(","), default=[])
    p.add_argument("-q", "--quiet", action="store_true")
    a = p.parse_args(arguments)
    try:
        manifest = config.read_manifest(f"{a.data_dir}/manifest.yaml")
    except FileNotFoundError:
        manifest = None
    run(SparkSession.builder.getOrCreate(), a.data_dir, manifest, a.stages, a.skip, a.quiet)


if __name__ == "__main__":
    main()
