"""Banded least squares: smoothing, fusion of window predictions, and assimilation of slow series."""

from __future__ import annotations

import numpy as np


def solve_banded(diagonals: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve symmetric positive systems by Cholesky's method.

    diagonals[d, i] is the element (i, i + d); a third axis, in both arguments, holds systems that are
    solved side by side.
    """
    width, n = diagonals.shape[:2]
    low = np.zeros_like(diagonals)  # low[d, i] is the factor's element (i + d, i)
    for j in range(n):
        reach = min(width, n - j)
        column = diagonals[:reach, j].copy()
        for k in range(max(0, j - width + 1), j):
            d = j - k
            m = min(width - d, reach)
            column[:m] -= low[d, k] * low[d : d + m, k]
        low[0, j] = np.sqrt(column[0])
        low[1:reach, j] = column[1:] / low[0, j]
    x = np.array(right, dtype=float)
    for j in range(n):
        x[j] /= low[0, j]
        m = min(width, n - j)
        x[j + 1 : j + m] -= low[1:m, j] * x[j]
    for j in range(n - 1, -1, -1):
        m = min(width, n - j)
        x[j] -= (low[1:m, j] * x[j + 1 : j + m]).sum(0)
        x[j] /= low[0, j]
    return x


def add_roughness(diagonals: np.ndarray, strength) -> None:
    """Add strength times the normal matrix of second differences."""
    n = diagonals.shape[1]
    for i in range(n - 2):
        for a, va in enumerate((1.0, -2.0, 1.0)):
            for b, vb in enumerate((1.0, -2.0, 1.0)):
                if b >= a:
                    diagonals[b - a, i + a] += strength * va * vb


def add_mean(diagonals: np.ndarray, right: np.ndarray, at: np.ndarray, weight: float, value) -> None:
    """Add an observation of the mean over the places ``at``: weight is that of the squared error."""
    share = 1 / len(at)
    for i in at:
        for j in at[at >= i]:
            diagonals[j - i, i] += weight * share * share
        right[i] += weight * share * value


def period_strength(period: float, smoothness: float = 1.0) -> float:
    """The strength at which a wave of the period is halved."""
    return float(smoothness / max(2 * np.sin(np.pi / period), 1e-6) ** 4)


def lowpass(years: np.ndarray, values: np.ndarray, period: float, smoothness: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(all years from first to last, smoothed values). Missing years have no weight."""
    if not len(years):
        return np.empty(0, dtype=int), np.empty(0)
    grid = np.arange(int(np.floor(years.min())), int(np.ceil(years.max())) + 1)
    total, count = np.zeros(len(grid)), np.zeros(len(grid))
    ok = np.isfinite(values)
    at = np.asarray(years, dtype=int)[ok] - grid[0]
    np.add.at(total, at, values[ok])
    np.add.at(count, at, 1.0)
    if not ok.any():
        return grid, np.full(len(grid), np.nan)
    have = count > 0
    d = np.zeros((3, len(grid)))
    d[0] = have + 1e-10
    add_roughness(d, period_strength(period, smoothness))
    return grid, solve_banded(d[: min(3, len(grid))], np.where(have, total / np.maximum(count, 1), 0.0))


def fuse(years: np.ndarray, core: np.ndarray, windows: list[tuple[int, int, np.ndarray]], weight: float, smoothness: float) -> tuple[np.ndarray, list[dict]]:
    """Move annual states towards window predictions.

    core: (years, runs); windows: (start, end, predictions by run). The increment of each run minimizes
    its squared size over the run's scale, the misfit of window means, and its roughness. Missing years
    of the core stay missing unless the smoothness reaches them.
    """
    core = core if core.ndim == 2 else core[:, None]
    seen = np.isfinite(core[:, 0])
    if not windows or weight == 0 or not seen.any():
        return core, []
    used, audit, width = [], [], 3
    for start, end, predicted in windows:
        at = np.flatnonzero((years >= start) & (years <= end) & seen)
        if len(at) and np.isfinite(predicted).any():
            used.append((at, predicted))
            width = max(width, int(at[-1] - at[0]) + 1)
            mean = core[at].mean(0)
            audit.append({"window_start": int(start), "window_end": int(end), "prediction": float(np.nanmedian(predicted)), "core_mean": float(np.median(mean)), "innovation": float(np.nanmedian(predicted - mean))})
    if not used:
        return core, []
    n, runs = len(years), core.shape[1]
    scales = np.maximum(np.nanstd(core, axis=0), 1e-6)
    d, right = np.zeros((min(width, n), n, runs)), np.zeros((n, runs))
    # where smoothness doesn't tie a missing year, its least increment is none
    d[0] = np.where(seen, 1.0, 1e-12)[:, None]
    for at, predicted in used:
        p = np.broadcast_to(predicted, runs)
        ok = np.isfinite(p)
        add_mean(d, right, at, weight * ok, np.where(ok, p - core[at].mean(0), 0.0))
    if n >= 3 and smoothness > 0:
        add_roughness(d, smoothness * scales**2)
    return core + solve_banded(d, right), audit


def support_widths(time: np.ndarray, multiplier: float | None, resolution: float) -> np.ndarray:
    if len(time) < 2:
        return np.ones(len(time))
    gap = np.diff(time)
    w = np.maximum((np.r_[gap[0], gap] + np.r_[gap, gap[-1]]) / 2, 1.0)
    return np.minimum(w, max(1.0, multiplier * resolution)) if multiplier is not None and np.isfinite(resolution) else w


def inside(years: np.ndarray, center: float, width: float) -> np.ndarray:
    half = max(width, 1.0) / 2
    return np.flatnonzero((years >= center - half) & (years < center + half))


def assimilate(years: np.ndarray, core: np.ndarray, slow: list[tuple[str, np.ndarray, np.ndarray]], target_years: np.ndarray, target: np.ndarray, cfg, samples: list[dict] | None = None) -> tuple[np.ndarray, list[dict]]:
    """Let slow series (pid, times, values) correct the low-pass part of an annual state; its high-pass part is kept.

    Each series is mapped to the low-pass target by a line over its samples' windows; the windows' misfits,
    weighted by the line's residual variance, meet the size and the roughness of the increment. The
    increment is smoothed, centred on the calibration years and bounded. Returns the state and an audit of
    the series; ``samples`` takes a row for each sample that has a say.
    """
    n = len(years)
    grid, low = lowpass(years, core, cfg.lowpass_period, cfg.smoothness)
    core_low = low[years - grid[0]]
    high = np.where(np.isfinite(core), core - core_low, 0.0)
    t_grid, t_low = lowpass(target_years, target, cfg.lowpass_period, cfg.smoothness)
    t_low = np.where(np.isfinite(target), t_low[target_years - t_grid[0]], np.nan) if len(target_years) else t_low
    scale = max(float(np.nanstd(core_low)), float(np.nanstd(t_low)) if len(t_low) else 0.0, 1e-6)
    rows, audit, width = [], [], 3
    for pid, time, value in slow:
        gaps = np.diff(np.unique(time))
        resolution = float(np.median(gaps)) if len(gaps) else np.nan
        spans = support_widths(time, cfg.support_multiplier, resolution)
        pairs = []
        for t, v, w in zip(time, value, spans):
            at = inside(target_years, t, w)
            at = at[np.isfinite(t_low[at])]
            if len(at):
                pairs.append((v, t_low[at].mean()))
        p = np.array(pairs).reshape(-1, 2)
        if not np.isfinite(resolution) or len(p) < cfg.minimum_overlap or p[:, 0].std() == 0:
            audit.append({"pid": pid, "status": "excluded_no_calibration", "native_resolution": resolution})
            continue
        slope, intercept = np.polyfit(p[:, 0], p[:, 1], 1)
        variance = max(float((p[:, 1] - intercept - slope * p[:, 0]).var(ddof=2 if len(p) > 2 else 0)), 1e-6)
        used = 0
        for t, v, w in zip(time, value, spans):
            at = inside(years, t, w)
            known = at[np.isfinite(core_low[at])]
            if len(known):
                mapped, before = intercept + slope * v, core_low[known].mean()
                rows.append((at, cfg.constraint_weight / variance, mapped - before))
                if samples is not None:
                    half = max(float(w), 1.0) / 2
                    own = {"pid": pid, "native_time": float(t), "proxy_value": float(v), "support_width_years": float(w), "support_start": t - half, "support_end": t + half, "annual_state_start": int(years[at[0]]), "annual_state_end": int(years[at[-1]]), "annual_state_count": len(at)}
                    samples.append(own | {"mapped_lowpass_value": float(mapped), "core_lowpass_window_mean": float(before), "innovation": float(mapped - before), "constraint_weight": float(np.sqrt(cfg.constraint_weight / variance))})
                width = max(width, int(at[-1] - at[0]) + 1)
                used += 1
        if used:
            support = {f"{name}_support_years": float(f(spans)) for name, f in (("minimum", np.min), ("median", np.median), ("maximum", np.max))}
            audit.append({"pid": pid, "status": "used", "native_resolution": resolution, **support, "calibration_overlap": len(p), "constraint_count": used, "psm_slope": float(slope), "psm_intercept": float(intercept), "psm_residual_variance": variance, "lowpass_period_years": cfg.lowpass_period, "increment_reference_scale": scale})
    if not rows:
        return core.copy(), audit
    d, right = np.zeros((min(width, n), n)), np.zeros(n)
    d[0] = np.where(np.isfinite(core_low), cfg.anchor_weight / scale**2, 0.0) + 1e-12
    for at, weight, value in rows:
        add_mean(d, right, at, weight, value)
    if n >= 3 and cfg.smoothness > 0:
        add_roughness(d, period_strength(cfg.lowpass_period, cfg.smoothness))
    step = solve_banded(d, right)
    g, step = lowpass(years, step, cfg.lowpass_period, cfg.smoothness)
    step = step[years - g[0]]
    common = np.isin(years, target_years)
    if cfg.preserve_mean and common.any():
        step = step - step[common].mean()
    if cfg.increment_ratio is not None and np.nanstd(step) > cfg.increment_ratio * scale:
        step = step * (cfg.increment_ratio * scale / np.nanstd(step))
    return high + core_low + step, audit


def lowpass_sections(period: float, order: int) -> list[tuple[float, float, float, float, float]]:
    """(b0, b1, b2, a1, a2) of a Butterworth low-pass as sections of second order, the last of first order if need be.

    Poles lie on a circle whose radius is the cutoff warped for the bilinear transform; each section passes
    a constant unchanged.
    """
    w = np.tan(np.pi / period)
    out = []
    for k in range(order // 2):
        damping = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order)) * w
        a0 = 1 + damping + w * w
        out.append((w * w / a0, 2 * w * w / a0, w * w / a0, 2 * (w * w - 1) / a0, (1 - damping + w * w) / a0))
    if order % 2:
        out.append((w / (1 + w), w / (1 + w), 0.0, (w - 1) / (1 + w), 0.0))
    return out


def through(sections: list[tuple[float, float, float, float, float]], x: np.ndarray) -> np.ndarray:
    """x through the sections one after another, each begun as if the first value had always been there."""
    for b0, b1, b2, a1, a2 in sections:
        s1, s2 = (1 - b0) * x[0], (b2 - a2) * x[0]
        y = np.empty(len(x))
        for k, v in enumerate(x):
            y[k] = u = b0 * v + s1
            s1, s2 = b1 * v - a1 * u + s2, b2 * v - a2 * u
        x = y
    return x


def butterworth(values: np.ndarray, period: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth low-pass: forward and backward over the series, continued by odd reflection at both ends."""
    n, m = len(values), 3 * (order + 1)
    if n < max(12, 3 * order) or n <= m:
        raise ValueError("too few values for the filter")
    x = np.concatenate([2 * values[0] - values[m:0:-1], values, 2 * values[-1] - values[-2 : -m - 2 : -1]])
    sections = lowpass_sections(period, order)
    return through(sections, through(sections, x)[::-1])[::-1][m : m + n]
