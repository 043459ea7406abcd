"""Kernels over whole series or pairs of series: change points, dynamics, dependence, topology, curves."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from . import kernels as k

_N = NormalDist()


def interpolate(y: np.ndarray) -> np.ndarray:
    ok = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok]) if ok.any() else np.zeros(len(y))


# --- change points ---------------------------------------------------------------------------------------------------


def noise_floor(y: np.ndarray, window: int = 50) -> np.ndarray:
    """1.4826 times the median distance from the median of the window/2 rows before, the row and those after it (one fewer)."""
    half, n = window // 2, len(y)
    out = np.empty(n)
    mad = lambda m: 1.4826 * np.median(np.abs(m - np.median(m, -1, keepdims=True)), -1)
    if n >= 2 * half:
        out[half : n - half + 1] = mad(np.lib.stride_tricks.sliding_window_view(y, 2 * half))
    for i in [*range(min(half, n)), *range(max(half, n - half + 1), n)]:
        out[i] = mad(y[max(0, i - half) : i + half])
    return out


def _shifts(y: np.ndarray, noise: np.ndarray, limit: float) -> list[tuple[int, float]]:
    """Two-sided cumulative sums about a slowly moving mean (weight 0.05, drift 0.5), which starts anew after each alarm."""
    found, mean, up, down = [], y[0], 0.0, 0.0
    for i in range(1, len(y)):
        e = (y[i] - mean) / noise[i]
        up, down = max(0.0, up + e - 0.5), max(0.0, down - e - 0.5)
        if max(up, down) > limit:
            found.append((i, float(max(up, down))))
            mean, up, down = y[i], 0.0, 0.0
        else:
            mean += 0.05 * (y[i] - mean)
    return found


def breaks(y: np.ndarray, sensitivity: float = 1.0, spacing: int = 10, context: int = 50) -> list[dict]:
    """Steps and impulses: cumulative sums (4), jumps (5) and spikes (5) over a local noise floor, merged within the spacing and described.

    Where the floor is zero, noise counts as one. magnitude and sharpness are in units of the floor. A series of under two contexts
    and one spacing, or without a number, has none."""
    n = len(y)
    if n < 2 * context + spacing or not np.isfinite(y).any():
        return []
    y = interpolate(y)
    floor = noise_floor(y, context)
    noise = np.where(floor > 1e-10, floor, 1.0)
    jump = np.abs(np.diff(y)) / noise[1:]
    found = _shifts(y, noise, 4 / sensitivity) + [(int(i) + 1, float(jump[i])) for i in np.flatnonzero(jump > 5 / sensitivity)]
    if n > 50:
        others = np.delete(np.lib.stride_tricks.sliding_window_view(y, 51), 25, 1)
        mid = np.median(others, 1)
        mad = 1.4826 * np.median(np.abs(others - mid[:, None]), 1)
        spike = np.where(mad >= 1e-10, np.abs(y[25 : n - 25] - mid) / np.where(mad >= 1e-10, mad, 1), 0)
        found += [(int(i) + 25, float(spike[i])) for i in np.flatnonzero(spike > 5 / sensitivity)]
    kept: list[tuple[int, float]] = []
    for i, score in sorted(found):
        if kept and i - kept[-1][0] < spacing:
            if score > kept[-1][1]:
                kept[-1] = (i, score)
        else:
            kept.append((i, score))
    out = []
    for i, score in kept:
        pre, post = y[max(0, i - context) : i], y[i + 1 : i + context]
        a, b = (float(np.median(part)) if len(part) else float(y[i]) for part in (pre, post))
        level, peak = b - a, float(y[i] - (a + b) / 2)
        impulse = abs(peak) > abs(level)
        size = peak if impulse else level
        duration = 1 if impulse or i + 2 >= n else _settles(y, i, noise[i])
        direction = 0 if abs(size) < 1e-10 else int(np.sign(size))
        units = float(size / noise[i])
        out.append({"index": i, "kind": "impulse" if impulse else "step", "magnitude": units, "direction": direction, "sharpness": abs(units) / duration, "duration": duration, "pre_level": a, "post_level": b, "snr": abs(units), "score": score})
    return out


def _settles(y: np.ndarray, i: int, noise: float, most: int = 20) -> int:
    """Rows until a value comes within two noises of the level that follows."""
    later = y[i + 5 : i + 50]
    calm = np.flatnonzero(np.abs(y[i + 1 : i + most] - (np.median(later) if len(later) else y[i + 1])) < 2 * noise)
    return int(calm[0]) + 1 if len(calm) else most


# --- dynamics --------------------------------------------------------------------------------------------------------


def kantz(row: np.ndarray, dim: int, delay: int, steps: int = 15, radius: float = 0.2) -> tuple[float, int]:
    e = k.embed(row, dim, delay)
    n = len(e) - steps
    if n < 10:
        return math.nan, 0
    d = k._distances(e)
    i = np.arange(n)
    close = (d[:n, :n] < radius * row.std() * math.sqrt(dim)) & (np.abs(i[:, None] - i[None]) > dim * delay)
    rows = close.any(1)
    if not rows.any():
        return math.nan, 0
    curve = []
    for s in range(steps):
        gap = np.abs(e[s : n + s, -1][:, None] - e[s : n + s, -1][None])
        m = np.where(close, gap, 0).sum(1)[rows] / close.sum(1)[rows]
        curve.append(np.log(np.maximum(m, 1e-12)).mean())
    return float(k.line(np.array(curve)[None])[0][0]), steps


def ftle(y: np.ndarray, least: int = 200, method: str = "rosenstein", cap: int = 2000) -> dict:
    y = y[np.isfinite(y)][-cap:]
    if len(y) < least or y.std() < 1e-12:
        return {"ftle": math.nan, "embedding_dim": 0, "embedding_tau": 0, "confidence": 0.0, "n_samples": len(y)}
    tau = min(k.optimal_delay(y), max(1, len(y) // 20))
    dim = k.optimal_dimension(y[:500], tau)
    value, steps = rosenstein_or(method)(y, max(2, dim), tau)
    return {"ftle": value, "embedding_dim": max(2, dim), "embedding_tau": tau, "confidence": min(1.0, steps / 100), "n_samples": len(y)}


def rosenstein_or(method: str):
    return kantz if method == "kantz" else k.rosenstein


def stability(value: float) -> str:
    """Class by exponent."""
    if not math.isfinite(value):
        return "unknown"
    for limit, name in ((-0.1, "asymptotically_stable"), (-0.01, "stable"), (0.01, "marginally_stable"), (0.1, "weakly_unstable")):
        if value < limit:
            return name
    return "chaotic"


#: Metrics of a window of several signals.
METRICS = ["effective_dim", "condition_number", "total_variance", "eigenvalue_3", "eigenvalue_entropy", "ratio_2_1", "ratio_3_1", "mean_dist_to_centroid", "mean_abs_correlation", "hurst", "perm_entropy", "kurtosis", "trend_strength", "zero_crossing_rate", "centroid_kurtosis", "centroid_perm_entropy", "centroid_spectral_flatness", "algebraic_connectivity"]


def laplacian(weights: np.ndarray) -> np.ndarray:
    """Normalised Laplacian of a weighted graph; a node without weight stays apart."""
    degree = weights.sum(1)
    root = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)
    return np.diag((degree > 0).astype(float)) - root[:, None] * weights * root[None]


def window_metrics(m: np.ndarray) -> dict:
    """METRICS of a matrix of signals (rows) over a window: spectrum of their covariance, spread about the mean curve, its kind, links."""
    out = dict.fromkeys(METRICS, math.nan)
    ok = m[np.isfinite(m).all(1)]
    if len(ok) >= 2:
        val = np.maximum(np.linalg.eigvalsh(np.cov(ok))[::-1], 0)
        total, third = val.sum(), val[2] if len(val) > 2 else math.nan
        if total > 0:
            p = val[val > 0] / total
            out |= {"effective_dim": total**2 / (val**2).sum(), "condition_number": val[0] / max(val[-1], 1e-15), "total_variance": total, "eigenvalue_3": third, "eigenvalue_entropy": -(p * np.log(p)).sum(), "ratio_2_1": val[1] / val[0], "ratio_3_1": third / val[0]}
        links = np.abs(np.corrcoef(ok))
        out["mean_abs_correlation"] = np.nanmean(links[np.triu_indices(len(ok), 1)])
        if len(ok) >= 3 and np.isfinite(links).all():
            np.fill_diagonal(links, 0)
            out["algebraic_connectivity"] = np.linalg.eigvalsh(laplacian(links))[1]
    seen = np.isfinite(m).any(0)
    centre = np.divide(np.nansum(m, 0), np.isfinite(m).sum(0), out=np.full(m.shape[1], math.nan), where=seen)
    out["mean_dist_to_centroid"] = np.sqrt(np.nansum((m - centre) ** 2, axis=1)).mean()
    kind = {name: float(x[0]) for name, x in k.typology(centre[None]).items()}
    out |= {name: kind[name] for name in ("hurst", "perm_entropy", "kurtosis", "trend_strength", "zero_crossing_rate")}
    return out | {"centroid_kurtosis": kind["kurtosis"], "centroid_perm_entropy": kind["perm_entropy"], "centroid_spectral_flatness": kind["spectral_flatness"]}


#: Points whose neighbours fit one word; windows whose tables fit a cache.
FEW, AT_ONCE = 64, 128


def _near(rank: np.ndarray, w: np.ndarray, x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A bit for each point that an edge before e joins with x, in window w."""
    return np.packbits((rank.reshape(-1, FEW).take(w * rank.shape[1] + x, axis=0) < e.astype(rank.dtype)[:, None]).ravel(), bitorder="little").view(np.uint64)


def _lowest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of each word, and its number."""
    bit = bits & (~bits + np.uint64(1))
    return bit, np.bitwise_count(bit - np.uint64(1)).astype(np.int64)


def _pieces(rank: np.ndarray, w: np.ndarray, e: np.ndarray, lune: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, edge, corner): a corner in each component of an edge's lune but the first."""
    found, rest, met = [], lune, np.zeros_like(lune)
    open_, _ = _lowest(rest)
    while len(w):
        bit, x = _lowest(open_)
        met = met | bit
        open_ = (open_ | _near(rank, w, x, e) & rest) & ~met
        left = (met | open_) != rest
        w, e, rest, met, open_ = (v[left] for v in (w, e, rest, met, open_))
        shut = open_ == 0
        rest[shut] &= ~met[shut]
        met[shut] = 0
        open_[shut], x = _lowest(rest[shut])
        found.append((w[shut], e[shut], x))
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, int)]) for i in range(3))


def _lifetimes(points: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
    """Rips lifetimes of each window (windows, at most FEW points, dimensions): of components by length, of loops by death.

    Exact: an edge with a third corner joined by shorter edges is, up to earlier triangles, the sum of the two other sides, so a loop
    is told by the edges without one (beyond a spanning tree these are the births), and only an edge whose corners fall into several
    components fills a loop. Once one point is joined with all others no loop is left."""
    b, n, _ = points.shape
    # the most central point is the lowest bit: it is mostly joined with all of a lune, which ends the search for its components
    central = np.argsort(((points - points.mean(1, keepdims=True)) ** 2).sum(2), 1)
    points = np.take_along_axis(points, central[:, :, None], 1)
    i, j = np.triu_indices(n, 1)
    d = np.sqrt(sum((x[:, i] - x[:, j]) ** 2 for x in np.moveaxis(points, 2, 0)))
    order, m, row = np.argsort(d, 1, kind="stable"), len(i), np.arange(b)[:, None]
    d = np.take_along_axis(d, order, 1)
    rank = np.full((b, n, FEW), m, np.int16)  # a point and itself, and what is no point: never joined
    rank[row, i[order], j[order]] = rank[row, j[order], i[order]] = np.arange(m)
    joined = np.where(np.eye(n, FEW, dtype=bool) | (np.arange(FEW) >= n), -1, rank).max(2).min(1)
    last = int(joined.max()) + 1
    p, q = i[order[:, :last]], j[order[:, :last]]

    tree, inside, reach = np.empty((b, n - 1), np.int64), np.zeros((b, FEW), bool), rank[:, 0].copy()
    inside[:, 0] = True
    for k_ in range(n - 1):
        x = np.where(inside, m, reach).argmin(1)
        tree[:, k_] = reach[row[:, 0], x]
        inside[row[:, 0], x] = True
        reach = np.minimum(reach, rank[row[:, 0], x])
    tree.sort(1)

    turn = np.argsort(rank[:, :, :n], 2, kind="stable")  # of each point the others, by length
    bits = np.uint64(1) << turn.astype(np.uint64)
    before = np.empty_like(bits)  # of two points: those nearer the first than the second is
    np.put_along_axis(before, turn, bits.cumsum(2, dtype=np.uint64) - bits, 2)
    lune, base = before.ravel(), row * n * n
    lune = lune.take(base + p * n + q) & lune.take(base + q * n + p)
    some = lune != 0
    births = ~some
    births[row, tree] = False
    some &= np.arange(last) <= joined[:, None]
    (w, e), lune = some.nonzero(), lune[some]
    _, x = _lowest(lune)
    sides = np.zeros((2, last, b), np.int64)
    for side, corner in zip(sides, (p, q)):
        side[e, w] = rank[w, corner[w, e], x]
    number = births.cumsum(1) - 1
    most = int(number.max()) + 1
    told = np.array([1 << k_ for k_ in range(most + 1)], np.uint64 if most < FEW else object)
    sums = np.where(births, told[number], told[0] ^ told[0]).T.copy()
    for e_ in range(last):  # of no sides: the first edge twice, which is nothing
        sums[e_] ^= sums[sides[0, e_], row[:, 0]] ^ sums[sides[1, e_], row[:, 0]]

    w, e, x = _pieces(rank, w, e, lune)
    loop = sums[e, w] ^ sums[rank[w, p[w, e], x], w] ^ sums[rank[w, q[w, e], x], w]
    turn = np.lexsort((e, w))
    turn = turn[loop[turn] != 0]
    born, lows, h1 = [d[k_, :last][births[k_]].tolist() for k_ in range(b)], [{} for _ in range(b)], [[] for _ in range(b)]
    for w_, death, v in zip(w[turn].tolist(), d[w[turn], e[turn]].tolist(), loop[turn].tolist()):
        low = lows[w_]
        while v and v.bit_length() in low:
            v ^= low[v.bit_length()]
        if v:
            low[v.bit_length()] = v
            birth = born[w_][v.bit_length() - 1]
            if death > birth:
                h1[w_].append(death - birth)
    return np.take_along_axis(d, tree, 1), h1


def _summaries(h0: np.ndarray, h1: list[list[float]]) -> dict[str, np.ndarray]:
    """Of each window's lifetimes: how many exceed their median, the longest, and the entropy of their shares."""
    loops = np.full((len(h1), max(map(len, h1), default=0)), math.nan)
    for row, x in zip(loops, h1):
        row[: len(x)] = x
    life = np.sort(np.hstack([h0, loops]), 1)
    n = np.isfinite(life).sum(1)[:, None]
    noise = (np.take_along_axis(life, (n - 1) // 2, 1) + np.take_along_axis(life, n // 2, 1)) / 2
    total = np.nansum(life, 1, keepdims=True)
    p = np.divide(life, total, out=np.zeros_like(life), where=(life > 0) & (total > 0))
    return {"n_components": (h0 > noise).sum(1), "n_loops": (loops > noise).sum(1), "max_persistence_h0": h0.max(1), "max_persistence_h1": np.nan_to_num(loops).max(1, initial=0.0), "persistence_entropy": -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)}


def homologies(windows: np.ndarray, least: int = 10) -> dict[str, np.ndarray]:
    """homology() of each window (windows, points, dimensions), all at once where their points are few and finite."""
    if len(windows) and least <= windows.shape[1] <= FEW and np.isfinite(windows).all():
        parts = [_summaries(*_lifetimes(windows[a : a + AT_ONCE])) for a in range(0, len(windows), AT_ONCE)]
        return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
    rows = [homology(w, least) for w in windows]
    return {c: np.array([r[c] for r in rows]) for c in ("n_components", "n_loops", "max_persistence_h0", "max_persistence_h1", "persistence_entropy")}


def homology(points: np.ndarray, least: int = 10, cap: int = 120, seed: int = 42) -> dict:
    """Vietoris-Rips lifetimes: components by a spanning tree, loops by reduction of the triangle boundaries."""
    points = points[np.isfinite(points).all(1)]
    if len(points) < least:
        return {"n_components": 0, "n_loops": 0, "max_persistence_h0": math.nan, "max_persistence_h1": math.nan, "persistence_entropy": math.nan}
    if len(points) > cap:
        points = points[np.sort(np.random.default_rng(seed).choice(len(points), cap, replace=False))]
    d, n = k._distances(points), len(points)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    i, j, w = i[order], j[order], d[i, j][order]
    root, h0 = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in range(len(w)):
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[b] = a
            h0.append(float(w[e]))
    rank = np.full((n, n), -1)
    rank[i, j] = rank[j, i] = np.arange(len(w))
    # Of the triangles whose longest side is e, those with third corners joined by shorter edges have one boundary up to
    # earlier triangles (their tetrahedron's), so one of each component of these corners stands for all.
    near, low, h1 = [0] * n, {}, []
    for e in range(len(w)):
        a, b = int(i[e]), int(j[e])
        lune = near[a] & near[b]
        while lune:
            x = (lune & -lune).bit_length() - 1
            met, open_ = 0, 1 << x
            while open_:
                y = (open_ & -open_).bit_length() - 1
                met |= 1 << y
                open_ = (open_ | near[y] & lune) & ~met
            lune &= ~met
            col = 1 << e | 1 << int(rank[a, x]) | 1 << int(rank[b, x])
            while col and col.bit_length() in low:
                col ^= low[col.bit_length()]
            if col:
                low[col.bit_length()] = col
                birth, death = float(w[col.bit_length() - 1]), float(w[e])
                if death > birth:
                    h1.append(death - birth)
        near[a] |= 1 << b
        near[b] |= 1 << a
    life = np.array([*h0, *h1])
    noise = np.median(life) if len(life) else 0.0
    p = life / life.sum() if len(life) and life.sum() > 0 else np.zeros(0)
    p = p[p > 0]
    return {"n_components": int((np.array(h0) > noise).sum()), "n_loops": int((np.array(h1) > noise).sum()) if h1 else 0, "max_persistence_h0": max(h0, default=0.0), "max_persistence_h1": max(h1, default=0.0), "persistence_entropy": float(-(p * np.log(p)).sum())}


def _jacobians(e: np.ndarray, neighbours: int):
    d = k._distances(e[:-1])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :neighbours]
    for t in range(len(e) - 1):
        a, b = e[near[t]] - e[t], e[near[t] + 1] - e[t + 1]
        yield np.linalg.lstsq(a, b, rcond=None)[0].T


def saddles(y: np.ndarray, least: int = 100, cap: int = 400) -> dict:
    """Where motion is slow and the local map both stretches and shrinks."""
    y = y[np.isfinite(y)][-cap:]
    if len(y) < least or y.std() < 1e-12:
        return {"max_saddle_score": math.nan, "mean_saddle_score": math.nan, "last_saddle_score": math.nan, "n_saddles": 0, "basin_stability": math.nan}
    tau = k.optimal_delay(y)
    e = k.embed((y - y.mean()) / y.std(), 3, tau)
    speed = np.linalg.norm(np.diff(e, axis=0), axis=1)
    score = []
    for s, jac in zip(speed, _jacobians(e, 2 * e.shape[1] + 2)):
        m = np.abs(np.linalg.eigvals(jac))
        mixed = min((m > 1).sum(), (m < 1).sum()) / (len(m) / 2)
        score.append(min(1.0, mixed) / (1 + s))
    s = np.array(score)
    return {"max_saddle_score": s.max(), "mean_saddle_score": s.mean(), "last_saddle_score": s[-1], "n_saddles": int(((s > 0.5) & (speed < np.quantile(speed, 0.1))).sum()), "basin_stability": 1 - s[-20:].mean()}


def sensitivity(m: np.ndarray, horizon: int = 10, neighbours: int = 10) -> np.ndarray:
    """Mean log growth of neighbours' gaps, by variable, of a standardised trajectory."""
    z = (m - m.mean(0)) / np.maximum(m.std(0), 1e-12)
    n = len(z) - horizon
    if n <= neighbours:
        return np.full(m.shape[1], math.nan)
    d = k._distances(z[:n])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :neighbours]
    now, later = np.abs(z[near] - z[:n, None]), np.abs(z[near + horizon] - z[horizon:, None])
    return np.log((later + 1e-9) / (now + 1e-9)).mean((0, 1)) / horizon


# --- pairs -----------------------------------------------------------------------------------------------------------


def pearson(x, y) -> float:
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 1e-12 and y.std() > 1e-12 else math.nan


def ranks(x: np.ndarray) -> np.ndarray:
    r = np.empty(len(x))
    r[np.argsort(x, kind="stable")] = np.arange(len(x))
    return r


def cross_correlation(x, y, lags: int = 50) -> dict:
    n, lags = len(x), min(lags, len(x) // 2)
    a, b = x - x.mean(), y - y.mean()
    s = math.sqrt((a @ a) * (b @ b))
    if s < 1e-12:
        return {"max_xcorr": math.nan, "lag_at_max": 0, "xcorr_symmetry": math.nan}
    c = np.array([a[max(0, -l) : n - max(0, l)] @ b[max(0, l) : n - max(0, -l)] for l in range(-lags, lags + 1)]) / s
    i = int(np.abs(c).argmax())
    return {"max_xcorr": float(c[i]), "lag_at_max": i - lags, "xcorr_symmetry": float(1 - np.abs(c - c[::-1]).mean())}


def _bins(x: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(((x - x.min()) / max(np.ptp(x), 1e-12) * n).astype(int), n - 1)


def _h(*cols: np.ndarray) -> float:
    key = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        key = key * 64 + c
    p = np.unique(key, return_counts=True)[1] / len(key)
    return float(-(p * np.log(p)).sum())


def mutual_information(x, y, n: int = 10) -> dict:
    a, b = _bins(x, n), _bins(y, n)
    ha, hb = _h(a), _h(b)
    mi = max(0.0, ha + hb - _h(a, b))
    return {"mutual_info": mi, "normalized_mi": mi / math.sqrt(ha * hb) if ha * hb > 0 else 0.0}


def transfer_entropy(x, y, lag: int = 1, n: int = 8) -> float:
    """From x to y, over the entropy of y."""
    a, b = _bins(x, n), _bins(y, n)
    now, past, other = b[lag:], b[:-lag], a[:-lag]
    te = _h(now, past) - _h(past) - _h(now, past, other) + _h(past, other)
    return max(0.0, te) / max(_h(b), 1e-12)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * f


def f_tail(f: float, d1: int, d2: int) -> float:
    return _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def granger(x, y, lag: int = 5) -> tuple[float, float]:
    """F and p of x's past in y's regression on its own."""
    n = len(y) - lag
    if len(y) < 25 or x.std() < 1e-12 or y.std() < 1e-12:
        return math.nan, math.nan
    own = np.column_stack([np.ones(n), *[y[lag - i : len(y) - i] for i in range(1, lag + 1)]])
    full = np.column_stack([own, *[x[lag - i : len(x) - i] for i in range(1, lag + 1)]])
    r0, r1 = k._ols(own, y[lag:])[1], k._ols(full, y[lag:])[1]
    rest = n - 2 * lag - 1
    f = max(0.0, (r0 - r1) / lag / max(r1 / rest, 1e-300))
    return f, f_tail(f, lag, rest)


def granger_of(r: np.ndarray, n: int, lag: int) -> tuple[float, float]:
    """granger() of n rows from the triangle of their regression: columns one, own past, the other's past, target."""
    r0, r1 = (k._ols(r[:, :c], r[:, -1])[1] for c in (lag + 1, 2 * lag + 1))
    rest = n - 3 * lag - 1
    f = max(0.0, (r0 - r1) / lag / max(r1 / rest, 1e-300))
    return f, f_tail(f, lag, rest)


def cointegration(x, y) -> dict:
    """Engle-Granger: Dickey-Fuller of the regression's residuals against fixed critical values; half life and spread."""
    if x.std() < 1e-12 or y.std() < 1e-12:
        return {"coint_stat": math.nan, "cointegrated": False, "half_life": math.nan, "spread_z": math.nan, "hedge_ratio": math.nan}
    b, _, r = k._ols(np.column_stack([np.ones(len(x)), y]), x)
    t = k.adf(r)[0]
    phi = float(r[:-1] @ r[1:] / max(r[:-1] @ r[:-1], 1e-300))
    return {"coint_stat": t, "cointegrated": bool(t < -3.34), "half_life": -math.log(2) / math.log(phi) if 0 < phi < 1 else math.nan, "spread_z": float((r[-1] - r.mean()) / max(r.std(), 1e-12)), "hedge_ratio": float(b[1])}


def kendall(x, y, cap: int = 1000, seed: int = 42) -> float:
    if len(x) > cap:
        i = np.random.default_rng(seed).choice(len(x), cap, replace=False)
        x, y = x[i], y[i]
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    c, d = (s > 0).sum(), (s < 0).sum()
    return float((c - d) / max(1, c + d))


def _frank_tau(theta: float) -> float:
    t = np.linspace(1e-6, abs(theta), 400)
    f = t / np.expm1(t)
    debye = float(((f[1:] + f[:-1]) / 2 * np.diff(t)).sum()) / abs(theta)
    return math.copysign(1 - 4 / abs(theta) * (1 - debye), theta)


def copula(x, y) -> dict:
    """Families fitted by inversion of Kendall's tau, the best by AIC; tail dependence, empirical and of the family."""
    n = len(x)
    u, v = (ranks(x) + 1) / (n + 1), (ranks(y) + 1) / (n + 1)
    tau = kendall(x, y)
    fits: dict[str, tuple[float, float]] = {}
    rho = math.sin(math.pi * tau / 2)
    if abs(rho) < 0.999:
        a, b = (np.array([_N.inv_cdf(p) for p in w]) for w in (u, v))
        fits["gaussian"] = rho, float((-0.5 * math.log(1 - rho**2) - (rho**2 * (a**2 + b**2) - 2 * rho * a * b) / (2 * (1 - rho**2))).sum())
    if 0.01 < tau < 0.99:
        th = 2 * tau / (1 - tau)
        fits["clayton"] = th, float((math.log(1 + th) - (1 + th) * np.log(u * v) - (2 + 1 / th) * np.log(np.maximum(u**-th + v**-th - 1, 1e-300))).sum())
        g = 1 / (1 - tau)
        a, b = -np.log(u), -np.log(v)
        s = a**g + b**g
        fits["gumbel"] = g, float((-(s ** (1 / g)) + (g - 1) * np.log(a * b) - np.log(u * v) + (1 / g - 2) * np.log(s) + np.log(s ** (1 / g) + g - 1)).sum())
    if abs(tau) > 0.01:
        lo, hi = (1e-3, 60.0) if tau > 0 else (-60.0, -1e-3)
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _frank_tau(mid) < tau else (lo, mid)
        th = (lo + hi) / 2
        e = np.exp(-th * (u + v))
        den = -np.expm1(-th) - (-np.expm1(-th * u)) * (-np.expm1(-th * v))
        fits["frank"] = th, float(np.log(np.maximum(th * -np.expm1(-th) * e / den**2, 1e-300)).sum())
    best = min(fits, key=lambda f: 2 - 2 * fits[f][1]) if fits else "independent"
    p = fits.get(best, (0.0, 0.0))[0]
    low, high = {"clayton": (2 ** (-1 / p) if p > 0 else 0.0, 0.0), "gumbel": (0.0, 2 - 2 ** (1 / p) if p >= 1 else 0.0)}.get(best, (0.0, 0.0))
    tail = lambda m: float(m.mean() / 0.1)
    return {"copula": best, "copula_param": p, "copula_aic": 2 - 2 * fits[best][1] if fits else math.nan, "kendall_tau": tau, "spearman_rho": pearson(ranks(x), ranks(y)), "tail_lower": low, "tail_upper": high, "empirical_tail_lower": tail((u <= 0.1) & (v <= 0.1)), "empirical_tail_upper": tail((u > 0.9) & (v > 0.9))}


def dtw(x, y) -> float:
    """Dynamic time warping with absolute cost, by anti-diagonals."""
    n, m = len(x), len(y)
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        cost = np.abs(x[i] - y[s - i])
        least = np.minimum(np.minimum(last[i], last[i + 1]), before[i])
        now = np.full(n + 1, np.inf)
        now[i + 1] = cost + (least if s else 0.0)
        before, last = last, now
    return float(last[n])


def divergences(x, y, n: int = 20) -> dict:
    edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()) + 1e-12, n + 1)
    p, q = (np.histogram(v, edges)[0] + 1e-10 for v in (x, y))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = lambda a, b: float((a * np.log(a / b)).sum())
    return {"kl_divergence": kl(p, q), "js_divergence": (kl(p, m) + kl(q, m)) / 2}


def pair(x: np.ndarray, y: np.ndarray, least: int = 100, cap: int | None = 2000) -> dict | None:
    """All dependence measures of two series, paired by position after gaps are dropped."""
    x, y = (v[np.isfinite(v)][-cap if cap else 0 :] for v in (x, y))
    n = min(len(x), len(y))
    if n < least:
        return None
    x, y = x[-n:], y[-n:]
    fab, pab = granger(x, y)
    fba, pba = granger(y, x)
    m = min(n, 300)
    return {"n": n, "correlation": pearson(x, y), **cross_correlation(x, y), **mutual_information(x, y), "transfer_entropy_ab": transfer_entropy(x, y), "transfer_entropy_ba": transfer_entropy(y, x), "granger_f_ab": fab, "granger_p_ab": pab, "granger_f_ba": fba, "granger_p_ba": pba, **cointegration(x, y), **copula(x, y), "dtw": dtw(x[-m:], y[-m:]), **divergences(x, y)}


# --- curves and fleets -----------------------------------------------------------------------------------------------


def ward(d: np.ndarray, count: int) -> np.ndarray:
    """Labels of that many clusters by Ward's linkage on a distance matrix (Lance-Williams updates)."""
    n = len(d)
    d, size, label = d.astype(float) ** 2, np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    live = list(range(n))
    while len(live) > max(1, count):
        sub = d[np.ix_(live, live)]
        a, b = sorted(np.unravel_index(sub.argmin(), sub.shape))
        i, j = live[a], live[b]
        for o in live:
            if o not in (i, j):
                d[i, o] = d[o, i] = ((size[i] + size[o]) * d[i, o] + (size[j] + size[o]) * d[j, o] - size[o] * d[i, j]) / (size[i] + size[j] + size[o])
        size[i] += size[j]
        label[label == j] = i
        live.remove(j)
    return np.unique(label, return_inverse=True)[1]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    s = []
    for i in range(len(d)):
        own = (label == label[i]) & (np.arange(len(d)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min((d[i, label == o].mean() for o in np.unique(label) if o != label[i]), default=a)
        s.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(s))
