"""Numeric kernels over equal-length windows: each takes a matrix (windows x samples, finite) and returns columns.

Kernels work on all windows of a batch at once; only what is sequential by nature loops.
"""

from __future__ import annotations

import math

import numpy as np

Columns = dict[str, np.ndarray]
EPS = 1e-12


def _nan(n: int) -> np.ndarray:
    return np.full(n, np.nan)


def _div(a, b, least: float = EPS):
    b = np.asarray(b, float)
    return np.where(np.abs(b) > least, a / np.where(np.abs(b) > least, b, 1.0), np.nan)


def moments(x: np.ndarray) -> Columns:
    c = x - x.mean(1, keepdims=True)
    v = (c**2).mean(1)
    rms = np.sqrt((x**2).mean(1))
    return {"kurtosis": _div((c**4).mean(1), v**2) - 3, "skewness": _div((c**3).mean(1), v**1.5), "crest_factor": _div(np.abs(x).max(1), rms, 1e-15)}


def rms(x):
    return {"rms": np.sqrt((x**2).mean(1))}


def peak(x):
    return {"peak": np.abs(x).max(1), "peak_to_peak": np.ptp(x, axis=1)}


def pulsation(x):
    m, r = x.mean(1), np.ptp(x, axis=1)
    return {"pulsation_index": r / (np.abs(m) + 1e-10), "flow_mean": m, "flow_range": r}


def line(x: np.ndarray, t: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and r2 of each row on t (default: the index)."""
    t = np.arange(x.shape[1], dtype=float) if t is None else t
    c, y = t - t.mean(), x - x.mean(1, keepdims=True)
    slope = y @ c / (c @ c)
    total = (y**2).sum(1)
    r2 = np.where(total > EPS, slope**2 * (c @ c) / np.where(total > EPS, total, 1), 0.0)
    return slope, x.mean(1) - slope * t.mean(), r2


def trend(x):
    slope, cut, r2 = line(x)
    rest = x - cut[:, None] - slope[:, None] * np.arange(x.shape[1])
    return {"trend_slope": slope, "trend_r2": r2, "detrend_std": rest.std(1), "cusum_range": np.ptp(np.cumsum(x - x.mean(1, keepdims=True), 1), axis=1)}


def mann_kendall(x):
    n = x.shape[1]
    i, j = np.triu_indices(n, 1)
    d = x[:, j] - x[:, i]
    s = np.sign(d).sum(1)
    z = (s - np.sign(s)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
    return {"mk_stat": z, "mk_pvalue": p, "mk_slope": np.median(d / (j - i), axis=1)}


def rate_of_change(x):
    d = np.diff(x, axis=1)
    return {"mean_rate": d.mean(1), "max_rate": d.max(1), "min_rate": d.min(1), "rate_std": d.std(1), "abs_max_rate": np.abs(d).max(1)}


def _scales(n: int, most: int = 20) -> np.ndarray:
    top = max(11, min(n // 4, 500))
    return np.unique(np.geomspace(min(10, max(4, n // 8)), top, most).astype(int))


def hurst(x):
    """Rescaled range of the increments."""
    x = np.diff(x, axis=1)
    n, pts = x.shape[1], []
    ks = [k for k in _scales(n) if k >= 4 and n // k >= 1]
    for k in ks:
        parts = x[:, : n // k * k].reshape(len(x), -1, k)
        c = np.cumsum(parts - parts.mean(2, keepdims=True), 2)
        s = parts.std(2)
        rs = np.where(s > EPS, np.ptp(c, axis=2) / np.where(s > EPS, s, 1), np.nan)
        with np.errstate(all="ignore"):
            pts.append(np.log(np.nanmean(np.where(np.isnan(rs).all(1, keepdims=True), 1.0, rs), 1)))
    slope, _, r2 = line(np.stack(pts, 1), np.log(np.array(ks, float))) if len(ks) > 1 else (_nan(len(x)),) * 3
    return {"hurst": np.clip(slope, 0, 1), "hurst_r2": r2}


def dfa(x):
    n, pts, y = x.shape[1], [], np.cumsum(x - x.mean(1, keepdims=True), 1)
    ks = np.unique(np.geomspace(4, max(5, n // 4), 12).astype(int))
    for k in ks:
        parts = y[:, : n // k * k].reshape(-1, k)
        slope, cut, _ = line(parts)
        f = ((parts - cut[:, None] - slope[:, None] * np.arange(k)) ** 2).mean(1).reshape(len(x), -1)
        pts.append(0.5 * np.log(f.mean(1) + 1e-300))
    return {"dfa": line(np.stack(pts, 1), np.log(ks.astype(float)))[0]}


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased, normalised; windows x (lags + 1)."""
    n = x.shape[1]
    c = x - x.mean(1, keepdims=True)
    f = np.fft.rfft(c, 2 * n, axis=1)
    a = np.fft.irfft(np.abs(f) ** 2, axis=1)[:, : lags + 1]
    return a / np.where(a[:, :1] > EPS, a[:, :1], np.nan)


def acf_decay(x):
    lags = min(50, x.shape[1] // 2)
    a = autocorrelation(x, lags)
    below = a < 0.5
    return {"acf_lag1": a[:, 1], "acf_lag10": a[:, 10] if lags >= 10 else _nan(len(x)), "acf_half_life": np.where(below.any(1), below.argmax(1), np.nan)}


def permutation_entropy(x: np.ndarray, order: int = 3) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(x, order, axis=1)
    code = np.argsort(w, axis=2, kind="stable") @ (order ** np.arange(order))
    out = np.zeros(len(x))
    for c in np.unique(code):
        p = (code == c).mean(1)
        out -= np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)
    return out / math.log2(math.factorial(order))


def _matches(row: np.ndarray, m: int, r: float) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(row, m)
    return np.abs(w[:, None] - w[None]).max(2) <= r


def sample_entropy(x: np.ndarray, m: int = 2) -> np.ndarray:
    out = _nan(len(x))
    for i, row in enumerate(x):
        r = 0.2 * row.std()
        if r > EPS:
            b = _matches(row, m, r)[:-1, :-1]
            a = _matches(row, m + 1, r)
            nb, na = b.sum() - len(b), a.sum() - len(a)
            out[i] = -math.log(na / nb) if na > 0 and nb > 0 else np.nan
    return out


def approximate_entropy(x: np.ndarray, m: int = 2) -> np.ndarray:
    out = _nan(len(x))
    for i, row in enumerate(x):
        r = 0.2 * row.std()
        if r > EPS:
            out[i] = np.log(_matches(row, m, r).mean(1)).mean() - np.log(_matches(row, m + 1, r).mean(1)).mean()
    return out


def complexity(x):
    return {"sample_entropy": sample_entropy(x), "permutation_entropy": permutation_entropy(x), "approximate_entropy": approximate_entropy(x)}


def psd(x: np.ndarray, fs: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """One-sided periodogram density, mean removed."""
    n = x.shape[1]
    p = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)) ** 2 / (fs * n)
    p[:, 1 : (n + 1) // 2] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def spectral(x):
    f, p = psd(x)
    f, p = f[1:], p[:, 1:]
    total = p.sum(1)
    q = p / np.where(total > EPS, total, 1)[:, None]
    c = q @ f
    h = -(q * np.log(np.where(q > 0, q, 1))).sum(1) / math.log(max(2, len(f)))
    return {"dominant_freq": np.where(total > EPS, f[p.argmax(1)], 0), "spectral_entropy": h, "spectral_centroid": c, "spectral_bandwidth": np.sqrt(np.maximum((q * (f[None] - c[:, None]) ** 2).sum(1), 0)), "spectral_slope": _nan(len(x))}


def spectral_flatness(x: np.ndarray) -> np.ndarray:
    _, p = psd(x)
    p = p[:, 1:]
    ok = p > 0
    geo = np.exp(np.where(ok, np.log(np.where(ok, p, 1)), 0).sum(1) / np.maximum(ok.sum(1), 1))
    return _div(geo, np.where(ok, p, 0).sum(1) / np.maximum(ok.sum(1), 1), 1e-300)


def frequency_bands(x):
    f, p = psd(x)
    total, out = p.sum(1), {}
    for name, lo, hi in (("low", 0, 0.1), ("mid", 0.1, 0.5), ("high", 0.5, 1)):
        b = p[:, (f >= lo * f[-1]) & (f <= hi * f[-1])].sum(1)
        out |= {f"band_{name}": b, f"band_{name}_rel": _div(b, total)}
    return out | {"total_power": total, "nyquist": np.full(len(x), f[-1])}


def fundamental(x):
    f, p = psd(x)
    k = p[:, 1:].argmax(1) + 1
    top = p[np.arange(len(x)), k]
    return {"fundamental_freq": f[k], "fundamental_power": top, "fundamental_ratio": _div(top, p[:, 1:].sum(1)), "fundamental_confidence": _nan(len(x))}


def _harmonics(p: np.ndarray, k: np.ndarray, n: int) -> list[np.ndarray]:
    at = np.arange(len(p))
    return [np.where(h * k < p.shape[1], p[at, np.minimum(h * k, p.shape[1] - 1)], 0.0) for h in range(1, n + 1)]


def harmonics(x):
    f, p = psd(x)
    k = p[:, 1:].argmax(1) + 1
    amp = [np.sqrt(h) for h in _harmonics(p, k, 5)]
    return {"fundamental_freq": f[k], "fundamental_amplitude": amp[0], "harmonic_2x": amp[1], "harmonic_3x": amp[2], "thd": _div(np.sqrt(sum(a**2 for a in amp[1:])), amp[0])}


def thd(x, n: int = 10):
    _, p = psd(x)
    h = _harmonics(p, p[:, 1:].argmax(1) + 1, n)
    d = np.sqrt(_div(sum(h[1:]), h[0]))
    with np.errstate(all="ignore"):
        return {"thd_percent": 100 * d, "thd_db": 20 * np.log10(d), "n_harmonics_found": np.full(len(x), 5.0)}


def snr(x):
    _, p = psd(x)
    p = np.sort(p[:, 1:], 1)
    k = max(1, p.shape[1] // 10)
    s, r = p[:, -k:].sum(1), p[:, :-k].sum(1)
    with np.errstate(all="ignore"):
        return {"snr_db": 10 * np.log10(_div(s, r)), "signal_power": s, "noise_power": r}


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def envelope(x):
    e = np.abs(analytic(x))
    return {"envelope_rms": np.sqrt((e**2).mean(1)), "envelope_peak": e.max(1), "envelope_kurtosis": moments(e)["kurtosis"]}


def phase_coherence(x, segments: int = 4):
    ph = np.exp(1j * np.angle(analytic(x - x.mean(1, keepdims=True))))
    r = np.stack([np.abs(s.mean(1)) for s in np.array_split(ph, segments, axis=1)], 1)
    return {"phase_coherence": r.mean(1), "coherence_std": r.std(1), "coherence_trend": line(r)[0]}


def hilbert_stability(x):
    """Instantaneous frequency and amplitude of the analytic signal of the values as they are."""
    a = analytic(x)
    amp, turn = np.abs(a), np.diff(np.unwrap(np.angle(a), axis=1), axis=1)
    f = turn / (2 * np.pi)
    mean, sd, z = f.mean(1), f.std(1), moments(f)
    steady, spread = np.abs(mean) > EPS, sd > EPS
    return {
        "inst_freq_mean": mean, "inst_freq_std": sd, "inst_freq_stability": np.where(steady, np.clip(1 - sd / np.where(steady, np.abs(mean), 1), 0, 1), 0.0),
        "inst_freq_kurtosis": np.where(spread, z["kurtosis"], 0.0), "inst_freq_skewness": np.where(spread, z["skewness"], 0.0), "inst_freq_range": np.ptp(f, axis=1), "inst_freq_drift": line(f)[0],
        "inst_amp_cv": np.where(amp.mean(1) > EPS, _div(amp.std(1), amp.mean(1)), np.nan), "inst_amp_trend": line(amp)[0], "phase_coherence": np.cos(turn).mean(1), "am_fm_ratio": _div(amp.std(1), sd),
    }


def wavelet_stability(x):
    """Energy of three thirds of the spectrum (its mean included) and of short runs of the values."""
    p = np.abs(np.fft.rfft(x, axis=1)) ** 2
    n = p.shape[1]
    parts = np.stack([p[:, i * n // 3 : (i + 1) * n // 3].sum(1) for i in range(3)], 1)
    total = parts.sum(1)
    share = parts / np.where(total < EPS, np.nan, total)[:, None]
    run = np.lib.stride_tricks.sliding_window_view(x**2, max(x.shape[1] // 10, 2), axis=1).sum(2)
    live = total >= EPS
    known = lambda v: np.where(live, v, np.nan)
    wide = run.std(1) > EPS
    return {
        "wavelet_energy_low": share[:, 0], "wavelet_energy_mid": share[:, 1], "wavelet_energy_high": share[:, 2], "wavelet_energy_ratio": known(np.where(parts[:, 2] > EPS, parts[:, 0] / np.where(parts[:, 2] > EPS, parts[:, 2], 1), np.nan)),
        "wavelet_entropy": -(share * np.log(np.where(share > 0, share, 1))).sum(1), "wavelet_concentration": share.max(1), "wavelet_dominant_scale": known(parts.argmax(1).astype(float)),
        "wavelet_energy_drift": known(line(run)[0]), "wavelet_temporal_std": known(run.std(1)), "wavelet_intermittency": known(np.where(wide, ((run - run.mean(1, keepdims=True)) ** 4).mean(1) / np.where(wide, run.std(1), 1) ** 4 - 3, 0.0)),
    }


def harmonic_ratio(row: np.ndarray, n: int = 5) -> float:
    """Power of the strongest frequency and its multiples over the rest."""
    _, p = psd(np.asarray(row, float)[None])
    if p.shape[1] < 3:
        return math.nan
    held = sum(float(h[0]) for h in _harmonics(p, p[:, 1:].argmax(1) + 1, n))
    rest = float(p.sum()) - held
    return held / rest if rest > 0 else math.inf


def _ols(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    r = y - a @ b
    return b, float(r @ r), r


def adf(row: np.ndarray) -> tuple[float, float, int, int]:
    """Augmented Dickey-Fuller with a constant, lags by AIC, p by MacKinnon's response surface (fixed values)."""
    if np.ptp(row) < EPS:
        return -np.inf, 0.0, 0, len(row)
    d, n = np.diff(row), len(row)
    most = max(0, min(int(12 * (n / 100) ** 0.25), n // 2 - 2))

    def fit(k: int, start: int):
        y = d[start:]
        a = np.column_stack([row[start:-1], np.ones(len(y)), *[d[start - i : len(d) - i] for i in range(1, k + 1)]])
        b, sse, _ = _ols(a, y)
        return a, b, sse, len(y)

    aic = [m * math.log(max(sse, 1e-300) / m) + 2 * (k + 2) for k in range(most + 1) for _, _, sse, m in [fit(k, most)]]
    k = int(np.argmin(aic))
    a, b, sse, m = fit(k, k)
    cov = np.linalg.pinv(a.T @ a) * sse / max(1, m - k - 2)
    t = b[0] / math.sqrt(max(cov[0, 0], 1e-300))
    poly = [2.1659, 1.4412, 0.038269] if t <= -1.61 else [1.7339, 0.93202, -0.12745, -0.010368]
    z = sum(c * t**i for i, c in enumerate(poly))
    p = 1.0 if t > 2.74 else 0.0 if t < -18.83 else 0.5 * math.erfc(-z / math.sqrt(2))
    return t, p, k, m


def adf_stat(x):
    r = np.array([adf(row) for row in x], float).reshape(-1, 4)
    return {"adf_stat": r[:, 0], "adf_pvalue": r[:, 1], "adf_lags": r[:, 2], "adf_nobs": r[:, 3]}


def variance_ratio(x):
    n, v1, out = x.shape[1], np.diff(x, axis=1).var(1, ddof=1), {}
    for q in (2, 4, 8):
        out[f"variance_ratio_{q}"] = _div((x[:, q:] - x[:, :-q]).var(1, ddof=1), q * v1) if n > q + 1 else _nan(len(x))
    return out | {"variance_ratio": out["variance_ratio_2"], "variance_ratio_stat": (out["variance_ratio_2"] - 1) / math.sqrt(2 / n)}


def variance_growth(x):
    n, c = x.shape[1], np.cumsum(x - x.mean(1, keepdims=True), 1)
    ks = np.array([max(2, n // 8), max(3, n // 4), max(4, n // 2), n])
    v = np.stack([c[:, :k].var(1) for k in ks], 1)
    return {"variance_growth_rate": line(np.log(v + 1e-300), np.log(ks.astype(float)))[0], "variance_growth_ratio": _div(v[:, -1], v[:, 0])}


def embed(row: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(row) - (dim - 1) * delay
    return row[np.arange(max(n, 0))[:, None] + delay * np.arange(dim)]


def _distances(e: np.ndarray) -> np.ndarray:
    s = (e**2).sum(1)
    return np.sqrt(np.maximum(s[:, None] + s[None] - 2 * e @ e.T, 0))


def optimal_delay(row: np.ndarray, most: int | None = None) -> int:
    """First lag at which the autocorrelation is below 1/e."""
    most = max(1, min(most or len(row) // 4, len(row) - 2))
    below = np.flatnonzero(autocorrelation(row[None], most)[0] < 1 / math.e)
    return int(below[0]) if len(below) and below[0] > 0 else 1


def optimal_dimension(row: np.ndarray, delay: int = 1, most: int = 8, limit: float = 0.1) -> int:
    """Least dimension with at most that share of false nearest neighbours."""
    for m in range(1, most):
        n = len(row) - m * delay
        if n < 10:
            return m
        d = _distances(embed(row, m, delay)[:n])
        np.fill_diagonal(d, np.inf)
        j = d.argmin(1)
        near = d[np.arange(n), j]
        jump = np.abs(row[np.arange(n) + m * delay] - row[j + m * delay])
        if (jump > 15 * np.maximum(near, EPS)).mean() <= limit:
            return m
    return most


def rosenstein(row: np.ndarray, dim: int = 3, delay: int = 1, steps: int = 20) -> tuple[float, int]:
    """Largest exponent: slope of the mean log divergence of nearest neighbours; and the steps used."""
    e = embed(row, dim, delay)
    n = len(e) - steps
    if n < 10:
        steps = max(3, len(e) // 3)
        n = len(e) - steps
    if n < 5 or row.std() < EPS:
        return math.nan, 0
    d = _distances(e)
    i = np.arange(n)
    near = d[:n, :n] + np.where(np.abs(i[:, None] - i[None]) <= dim * delay, np.inf, 0)
    j = near.argmin(1)
    ok = np.isfinite(near[i, j])
    if not ok.any():
        return math.nan, 0
    i, j = i[ok], j[ok]
    curve = []
    for k in range(steps):
        v = d[i + k, j + k]
        v = v[v > EPS]
        curve.append(np.log(v).mean() if len(v) else np.nan)
    y = np.array(curve)
    t = np.flatnonzero(np.isfinite(y))
    return (float(line(y[t][None], t.astype(float))[0][0]), len(t)) if len(t) > 2 else (math.nan, len(t))


def lyapunov(x):
    r = [rosenstein(row) if len(row) >= 30 else (math.nan, 0) for row in x]
    return {"lyapunov": np.array([a for a, _ in r]), "lyapunov_confidence": np.array([min(1.0, k / 100) for _, k in r])}


def correlation_dimension(row: np.ndarray, dim: int = 5, delay: int = 1) -> float:
    e = embed(row, dim, delay)
    if len(e) < 10:
        return math.nan
    d = _distances(e)[np.triu_indices(len(e), 1)]
    d = d[d > 0]
    if len(d) < 10:
        return math.nan
    r = np.quantile(d, np.linspace(0.05, 0.5, 10))
    c = np.array([(d <= v).mean() for v in r])
    if np.ptp(np.log(r)) < EPS:
        return math.nan
    return float(line(np.log(c)[None], np.log(r))[0][0])


def attractor(x):
    out = []
    for row in x:
        delay = optimal_delay(row)
        out.append((optimal_dimension(row, delay), correlation_dimension(row, 3, delay), delay))
    r = np.array(out, float).reshape(-1, 3)
    return {"embedding_dim": r[:, 0], "correlation_dim": r[:, 1], "delay": r[:, 2]}


def runs(flags: np.ndarray) -> np.ndarray:
    """Lengths of runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[1::2] - edge[::2]


def recurrence(e: np.ndarray, share: float = 10.0) -> dict[str, float]:
    """Recurrence rate, determinism, laminarity, diagonal entropy and trapping time; threshold: a percentile of distances."""
    d = _distances(e)
    m = d <= np.percentile(d, share)
    n = len(m)
    diagonal = np.concatenate([runs(np.diagonal(m, k)) for k in range(1, n)] or [np.zeros(0, int)])
    vertical = np.concatenate([runs(c) for c in m.T] or [np.zeros(0, int)])
    long, tall = diagonal[diagonal >= 2], vertical[vertical >= 2]
    p = np.bincount(long)[2:] / len(long) if len(long) else np.zeros(0)
    p = p[p > 0]
    return {"recurrence_rate": float(m.sum() / n**2), "determinism": float(long.sum() / max(1, diagonal.sum())), "laminarity": float(tall.sum() / max(1, vertical.sum())), "diagonal_entropy": float(-(p * np.log(p)).sum()), "trapping_time": float(tall.mean()) if len(tall) else 0.0}


def rqa(x):
    out = []
    for row in x:
        r = recurrence(embed(row, 3, 1))
        out.append((r["recurrence_rate"], r["determinism"], correlation_dimension(row), optimal_dimension(row)))
    a = np.array(out, float).reshape(-1, 4)
    return dict(zip(("recurrence_rate", "determinism", "correlation_dimension", "embedding_dim"), a.T))


def dmd(x):
    out = []
    for row in x:
        h = embed(row, max(2, len(row) // 2), 1).T
        a, b = h[:, :-1], h[:, 1:]
        u, s, v = np.linalg.svd(a, full_matrices=False)
        r = max(1, int((s > 1e-8 * s[0]).sum())) if s[0] > EPS else 1
        r = min(r, 10)
        k = u[:, :r].T @ b @ v[:r].T / np.maximum(s[:r], EPS)
        lam = np.linalg.eigvals(k)
        top = lam[np.abs(lam).argmax()]
        growth = math.log(max(abs(top), 1e-300))
        out.append((abs(np.angle(top)) / (2 * np.pi), growth, float(growth <= 0), r))
    a = np.array(out, float).reshape(-1, 4)
    return dict(zip(("dmd_dominant_freq", "dmd_growth_rate", "dmd_is_stable", "dmd_n_modes"), a.T))


def lof(x, k: int = 20):
    out = []
    for row in x:
        m = min(k, len(row) - 1)
        d = np.abs(row[:, None] - row[None])
        np.fill_diagonal(d, np.inf)
        j = np.argsort(d, axis=1, kind="stable")[:, :m]
        near = np.take_along_axis(d, j, 1)
        density = m / np.maximum(np.maximum(near, near[:, -1][j]).sum(1), 1e-10)
        f = density[j].mean(1) / density
        out.append((f.max(), f.mean(), (f > 1.5).mean()))
    a = np.array(out, float).reshape(-1, 3)
    return dict(zip(("lof_max", "lof_mean", "outlier_fraction"), a.T)) | {"lof_std": _nan(len(x)), "n_outliers": np.zeros(len(x))}


def time_constant(x):
    out = []
    for row in x:
        d = np.diff(row)
        up, down = (d > 0).mean(), (d < 0).mean()
        if max(up, down) < 0.7:
            out.append((np.nan, np.nan, np.nan, np.nan))
            continue
        end = row[-1]
        gap = np.abs(row[:-1] - end) + EPS
        slope, _, r2 = line(np.log(gap)[None])
        out.append((-1 / slope[0] if slope[0] < 0 else np.nan, r2[0], float(down > up), end))
    a = np.array(out, float).reshape(-1, 4)
    return dict(zip(("time_constant", "fit_r2", "is_decay", "equilibrium_value"), a.T))


def levels(row: np.ndarray, bins: int = 10) -> np.ndarray:
    """Discrete states: the values themselves where few, else (lo, hi] bins with the minimum apart."""
    u, inverse = np.unique(row, return_inverse=True)
    if len(u) <= bins:
        return inverse
    return np.digitize(row, np.linspace(row.min(), row.max(), bins + 1), right=True)


def _entropy(p: np.ndarray, base: float = 2.0) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / math.log(base))


def _run_lengths(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]])
    return np.diff(cut), s[cut[:-1]]


def _each(x, of, names):
    a = np.array([of(row) for row in x], float).reshape(len(x), len(names))
    return dict(zip(names, a.T))


def level_count(x):
    def of(row):
        s = levels(row)
        p = np.bincount(s)[np.unique(s)] / len(s)
        return len(p), len(p) / 10, p.max(), np.ptp(s), _entropy(p)

    return _each(x, of, ("n_levels", "level_occupancy", "dominant_level", "level_spread", "level_entropy"))


def level_histogram(x):
    def of(row):
        h = np.bincount(levels(row), minlength=10) / len(row)
        s = np.sort(h)
        gini = 1 - 2 * np.cumsum(s).sum() / (len(s) * max(s.sum(), EPS)) + 1 / len(s)
        m = moments(row[None])
        k, g = m["kurtosis"][0], m["skewness"][0]
        return _entropy(h) / math.log2(len(h)), gini, s[-1] / max(s[-2], EPS), h[0] + h[-1], (g**2 + 1) / (k + 3) if np.isfinite(k) else np.nan

    return _each(x, of, ("uniformity", "concentration", "peak_ratio", "tail_weight", "bimodality"))


def transitions(x):
    def of(row):
        _, s = np.unique(levels(row), return_inverse=True)
        n = s.max() + 1
        t = np.bincount(s[:-1] * n + s[1:], minlength=n * n).reshape(n, n) / max(1, len(s) - 1)
        own = np.diag(t)
        rows = t.sum(1)
        stay = own / np.where(rows > 0, rows, 1)
        return _entropy(t.ravel()), own.sum(), stay.max(), np.abs(t - t.T).sum() / 2, (t > 0).sum(), (t == 0).mean(), int((np.diff(s) != 0).sum())

    return _each(x, of, ("transition_entropy", "self_loop", "max_self_loop", "asymmetry", "n_active", "sparsity", "transition_count"))


def dwell_times(x):
    def of(row):
        r, _ = _run_lengths(row)
        return r.mean(), r.std(), r.max(), r.min(), r.std() / r.mean(), len(r)

    return _each(x, of, ("dwell_mean", "dwell_std", "dwell_max", "dwell_min", "dwell_cv", "n_dwells"))


def duty_cycle(x):
    def of(row):
        p = np.sort(np.bincount(levels(row)) / len(row))[::-1]
        second = p[1] if len(p) > 1 else 0.0
        return p[0], second, p[0] / second if second else np.nan, 1 - (p[0] - second), np.ptp(p[p > 0])

    return _each(x, of, ("duty_dominant", "duty_secondary", "duty_ratio", "duty_balance", "duty_range"))


def mean_time_between(x):
    def of(row):
        r, s = _run_lengths(levels(row))
        m = np.array([r[s == v].mean() for v in np.unique(s)])
        return m.mean(), m.std(), m.max(), m.min(), m.std() / m.mean()

    return _each(x, of, ("mtb_mean", "mtb_std", "mtb_max", "mtb_min", "mtb_cv"))


def discrete_entropy(x):
    def of(row):
        _, s = np.unique(levels(row), return_inverse=True)
        n = s.max() + 1
        h1, h2 = _entropy(np.bincount(s) / len(s)), _entropy(np.bincount(s[:-1] * n + s[1:]) / max(1, len(s) - 1))
        return h1, h1 / math.log2(n) if n > 1 else 0.0, h2 - h1, h2 / 2, h1 - (h2 - h1)

    return _each(x, of, ("shannon_entropy", "normalized_entropy", "conditional_entropy", "entropy_rate", "excess_entropy"))


def basin(x, bins: int = 20):
    def of(row):
        if np.ptp(row) < EPS:
            return 1.0, 0.0, 1
        s = np.minimum(((row - row.min()) / np.ptp(row) * bins).astype(int), bins - 1)
        h = np.bincount(s, minlength=bins)
        inner = (h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])
        return (np.diff(s) == 0).mean(), (np.diff(s) != 0).mean(), max(1, int(inner.sum()))

    return _each(x, of, ("basin_stability", "transition_prob", "n_attractors"))


def turning_points(row: np.ndarray) -> np.ndarray:
    d = np.sign(np.diff(row))
    keep = np.flatnonzero(d[:-1] * d[1:] < 0) + 1
    return row[np.concatenate([[0], keep, [len(row) - 1]])]


def cycle_counting(x):
    def of(row):
        r = np.abs(np.diff(turning_points(row)))
        return len(r) / 2, r.mean(), r.max(), (r**3).sum()

    return _each(x, of, ("n_cycles", "mean_range", "max_range", "cycle_damage"))


def zero_crossings(x: np.ndarray) -> np.ndarray:
    return (np.diff(np.sign(x), axis=1) != 0).sum(1).astype(float)


def typology(x):
    """Eleven metrics of a window's kind."""
    n = x.shape[1]
    m, s = x.mean(1), x.std(1, ddof=1)
    long = lambda k, f: f() if n >= k else _nan(len(x))
    return {
        "hurst": long(20, lambda: hurst(x)["hurst"]), "perm_entropy": permutation_entropy(x), "sample_entropy": sample_entropy(x), "lyapunov_proxy": long(50, lambda: lyapunov(x)["lyapunov"]),
        "spectral_flatness": spectral_flatness(x), "kurtosis": moments(x)["kurtosis"], "cv": _div(s, np.abs(m)), "range_norm": _div(np.ptp(x, axis=1), np.abs(m)),
        "zero_crossing_rate": zero_crossings(x - m[:, None]) / (n - 1), "trend_strength": np.clip(line(x)[2], 0, 1), "mean_abs_diff": np.abs(np.diff(x, axis=1)).mean(1),
    }
