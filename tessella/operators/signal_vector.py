"""Window engines in Arrow batches: windows of equal length form a matrix, and each kernel runs once a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.engines import engine
from . import windows as W

RELAXED = {"hurst", "recurrence_rate", "determinism", "correlation_dimension", "embedding_dim", "lyapunov"}
KEYS = ["cohort", "signal_id", "window_id", "signal_0_start", "signal_0_end", "signal_0_center"]


def _outputs(names: list[str]) -> list[tuple[str, str, str]]:
    """(engine, output, column): a name that an earlier engine has is led by its engine's."""
    seen, out = set(), []
    for n in names:
        for o in engine(n).outputs:
            out.append((n, o, o if o not in seen else f"{n}_{o}"))
            seen.add(o)
    return out


def _run(names: list[str], widths: dict[str, int], outputs: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(KEYS))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(size)])
            rows = [flat[first[i] : first[i + 1]] for i in range(len(size))]
            made = {c: np.full(len(rows), np.nan) for _, _, c in outputs}
            for n in names:
                e, groups = engine(n), {}
                for i, row in enumerate(rows):
                    x = row[-widths[n] :]
                    enough = len(x) >= (e.least if n in RELAXED else widths[n])
                    x = x[np.isfinite(x)]
                    if enough and len(x) >= e.least:
                        groups.setdefault(len(x), ([], []))
                        groups[len(x)][0].append(i)
                        groups[len(x)][1].append(x)
                for at, xs in groups.values():
                    with np.errstate(all="ignore"):
                        got = e.kernel(np.array(xs, float))
                    for m, o, c in outputs:
                        if m == n:
                            made[c][at] = got[o]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEYS)], *[pa.array(v) for v in made.values()]], [*KEYS, *made])

    return run


def signal_vector(obs: DataFrame, names: list[str], width: int = 64, stride: int = 16, factor: float = 1.0, overrides: dict[str, int] | None = None, partial: bool = False) -> DataFrame:
    """Engine outputs for every window. Engines look back their own width from a shared end; the widest sets the frame."""
    widths = {n: (overrides or {}).get(n, engine(n).width(factor)) for n in names}
    outputs = _outputs(names)
    made = W.arrays(obs, width, stride, partial, max(widths.values()))
    schema = "cohort string, signal_id string, window_id long, signal_0_start double, signal_0_end double, signal_0_center double, " + ", ".join(f"`{c}` double" for _, _, c in outputs)
    return made.select(*KEYS, "values").mapInArrow(_run(names, widths, outputs), schema)


def gate(skip_when: dict[str, dict[str, float]]) -> Column:
    """Whether an engine is skipped for a typology row: any metric beyond its bound; NaN and private keys are ignored."""
    out = F.lit(False)
    for metric, rule in skip_when.items():
        if metric.startswith("_"):
            continue
        x = F.col(metric)
        ok = x.isNotNull() & ~F.isnan(x.cast("double"))
        hit = F.lit(False)
        if "gt" in rule:
            hit = hit | (x > rule["gt"])
        if "lt" in rule:
            hit = hit | (x < rule["lt"])
        if "min_n_obs" in rule:
            hit = hit | (F.col("n_obs") < rule["min_n_obs"])
        out = out | F.coalesce(ok & hit, F.lit(False))
    return out


def drop_dead(df: DataFrame, share: float = 0.9, keep: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """Without the columns that are null or NaN in more than that share of the rows."""
    cols = [c for c, t in df.dtypes if t == "double" and c not in keep]
    dead = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(c)).cast("double")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if dead[c] is None or dead[c] > share])


def drop_constant(df: DataFrame, keep: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    cols = [c for c, t in df.dtypes if t == "double" and c not in keep]
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not spread[c]])
