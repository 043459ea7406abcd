"""Registry of window engines: name, kernel, outputs and window requirement (base, least, most)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import kernels as k


@dataclass(frozen=True)
class Engine:
    name: str
    kernel: Callable[[np.ndarray], dict[str, np.ndarray]]
    base: int
    least: int
    most: int
    scaling: str = "linear"

    @property
    def outputs(self) -> list[str]:
        """Names, from a probe window: a wave, long enough for every kernel."""
        return list(self.kernel(np.sin(np.arange(64.0) ** 1.1)[None]))

    def width(self, factor: float = 1.0) -> int:
        f = {"linear": factor, "sqrt": factor**0.5, "log": float(np.log2(1 + factor))}[self.scaling]
        return max(self.least, min(self.most, int(self.base * f)))


def _none(*names: str):
    return lambda x: {n: np.full(len(x), np.nan) for n in names}


def _memory(x):
    return k.hurst(x)


def _one(kernel, name):
    return lambda x: {name: kernel(x)[name]}


_ROWS = [
    ("statistics", k.moments, 16, 4, 256), ("rms", k.rms, 4, 2, 1024), ("peak", k.peak, 4, 2, 1024), ("pulsation_index", k.pulsation, 10, 10, 1024), ("trend", k.trend, 32, 8, 256),
    ("mann_kendall", k.mann_kendall, 10, 10, 256), ("rate_of_change", k.rate_of_change, 16, 4, 128), ("hurst", k.hurst, 128, 32, 512), ("dfa", k.dfa, 32, 20, 512), ("memory", _memory, 48, 22, 256),
    ("acf_decay", k.acf_decay, 22, 22, 512), ("complexity", k.complexity, 64, 32, 256), ("spectral", k.spectral, 64, 32, 512), ("frequency_bands", k.frequency_bands, 64, 32, 512),
    ("fundamental_freq", k.fundamental, 64, 32, 512), ("harmonics", k.harmonics, 64, 32, 512), ("thd", k.thd, 64, 32, 512), ("snr", k.snr, 32, 16, 256), ("envelope", k.envelope, 32, 16, 256),
    ("phase_coherence", k.phase_coherence, 32, 16, 256), ("hilbert_stability", k.hilbert_stability, 16, 10, 512), ("wavelet_stability", k.wavelet_stability, 16, 10, 512), ("adf_stat", k.adf_stat, 64, 20, 256),
    ("variance_ratio", k.variance_ratio, 64, 20, 256), ("variance_growth", k.variance_growth, 32, 16, 256), ("lyapunov", k.lyapunov, 128, 64, 512), ("attractor", k.attractor, 64, 32, 512), ("rqa", k.rqa, 64, 50, 512),
    ("recurrence_rate", _one(k.rqa, "recurrence_rate"), 64, 30, 256), ("determinism", _one(k.rqa, "determinism"), 64, 30, 256), ("correlation_dimension", _one(k.rqa, "correlation_dimension"), 128, 64, 512),
    ("embedding_dim", _one(k.rqa, "embedding_dim"), 128, 64, 512), ("dmd", k.dmd, 64, 32, 512), ("garch", _none("garch_omega", "garch_alpha", "garch_beta", "garch_persistence"), 64, 32, 512),
    ("hmm", _none("hmm_n_states", "hmm_current_state", "hmm_bic"), 128, 30, 1024), ("lof", k.lof, 21, 21, 256), ("time_constant", k.time_constant, 16, 5, 256), ("basin", k.basin, 100, 100, 1024),
    ("cycle_counting", k.cycle_counting, 16, 5, 1024), ("dwell_times", k.dwell_times, 4, 4, 1024), ("level_count", k.level_count, 4, 4, 1024), ("level_histogram", k.level_histogram, 4, 4, 1024),
    ("transition_matrix", k.transitions, 4, 4, 1024), ("duty_cycle", k.duty_cycle, 4, 4, 1024), ("mean_time_between", k.mean_time_between, 4, 4, 1024), ("entropy", k.discrete_entropy, 4, 4, 1024), ("typology", k.typology, 50, 8, 512),
]
ENGINES: dict[str, Engine] = {n: Engine(n, f, b, lo, hi, "sqrt" if n == "complexity" else "linear") for n, f, b, lo, hi in _ROWS}
ALIASES = {"perm_entropy": "complexity", "sample_entropy": "complexity", "approximate_entropy": "complexity", "trend_r2": "trend", "detrend_std": "trend", "cusum": "trend", "spectral_entropy": "spectral", "band_power": "frequency_bands", "transition_count": "transition_matrix", "kurtosis": "statistics", "skewness": "statistics", "crest_factor": "statistics"}


def engine(name: str) -> Engine:
    return ENGINES[ALIASES.get(name, name)]
