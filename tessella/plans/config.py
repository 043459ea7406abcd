"""Manifests and layered configuration."""

from __future__ import annotations

import copy
from pathlib import Path

from ..sources.tables import load_manifest


def read_manifest(path: str) -> dict:
    """A manifest file; its folder is what relative paths are relative to."""
    file = Path(path).resolve()
    return {**load_manifest(file.read_text()), "_data_dir": str(file.parent)}


def _path(manifest: dict, key: str, default: str) -> str:
    return str(Path(manifest.get("_data_dir", ".")) / manifest.get("paths", {}).get(key, default))


def observations_path(manifest: dict) -> str:
    return _path(manifest, "observations", "observations.parquet")


def output_path(manifest: dict) -> str:
    """The output folder, made if it is not there."""
    path = _path(manifest, "output_dir", "output")
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def typology_path(manifest: dict) -> str | None:
    """None where there is no such file."""
    path = _path(manifest, "typology", "typology.parquet")
    return path if Path(path).exists() else None


def coordinate(manifest: dict) -> dict:
    """Name and unit of the coordinate."""
    return {"name": "signal_0", "unit": ""} | manifest.get("signal_0", {})


def segments(manifest: dict) -> list[tuple[str, float, float | None]] | None:
    """(name, from, to): the given ones, else before and after an enabled intervention, else None."""
    given = manifest.get("segments")
    event = manifest.get("intervention") or {}
    if not given and event.get("enabled"):
        at = event.get("event_index", 20)
        return [("pre", 0, at - 1), ("post", at, None)]
    return [(x["name"], *x["range"]) for x in given] if given else None


def problems(manifest: dict) -> list[str]:
    """What a manifest lacks."""
    out = [f"{k} is missing" for k in ("paths", "system", "cohorts") if k not in manifest]
    window, stride = (manifest.get("system", {}).get(k) for k in ("window", "stride"))
    out += [f"system.{k} is not a positive number" for k, v in (("window", window), ("stride", stride)) if "system" in manifest and not (isinstance(v, int) and v > 0)]
    return out + [f"cohort {c} has no signals" for c, signals in manifest.get("cohorts", {}).items() if not signals]


def for_cohort(manifest: dict, cohort: str) -> dict:
    return {**manifest, "cohorts": {c: v for c, v in manifest.get("cohorts", {}).items() if c == cohort}}


def without_signals(manifest: dict, constant: set[str]) -> dict:
    """The manifest without these signals, and without cohorts that they leave empty."""
    kept = {c: {s: v for s, v in signals.items() if s not in constant} for c, signals in manifest.get("cohorts", {}).items()}
    return {**manifest, "cohorts": {c: v for c, v in kept.items() if v}}


def skips_fleet(manifest: dict, n_cohorts: int) -> bool:
    """system.mode: skip and force do as they say; auto, or any other, needs two cohorts."""
    mode = manifest.get("system", {}).get("mode", "auto")
    return mode == "skip" or mode != "force" and n_cohorts < 2


def merged(base: dict, over: dict) -> dict:
    """over wins; tables are merged at every depth, lists are replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


class Config:
    """defaults, then domains/{domain}, then environments/{environment}: later files win."""

    def __init__(self, folder: str, domain: str | None = None, environment: str | None = None):
        root, self.values = Path(folder), {}
        names = [*sorted((root / "defaults").glob("*.*")), *[next(iter(sorted((root / kind).glob(f"{name}.*"))), None) for kind, name in (("domains", domain), ("environments", environment)) if name]]
        for file in names:
            if file is not None:
                self.values = merged(self.values, load_manifest(file.read_text()) or {})

    def get(self, dotted: str, default=None):
        value = self.values
        for key in dotted.split("."):
            if not isinstance(value, dict) or key not in value:
                return default
            value = value[key]
        return value
