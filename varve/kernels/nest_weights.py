"""Weights of the series of one nest, from its own fit rows."""

from __future__ import annotations

import numpy as np

from ..config import WeightConfig
from .skill import correlation


def haversine(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, lb = np.radians(a[0]), np.radians(b[0])
    d_lon = np.radians((b[1] - a[1] + 180) % 360 - 180)
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(d_lon / 2) ** 2
    return float(2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


def nest_weights(fit: np.ndarray, facts: list[dict], cfg: WeightConfig) -> np.ndarray:
    """Reliability times one over the size of the redundancy group; all 1 if weighting is off. facts: archive, proxy, site, source, lat, lon, error_sd."""
    n = fit.shape[1]
    if not cfg.enabled:
        return np.ones(n)
    weight = np.ones(n)
    for k, f in enumerate(facts):
        e = f.get("error_sd")
        if e is not None and e > 0:
            s2 = np.nanvar(fit[:, k], ddof=1)
            weight[k] = s2 / (s2 + e * e) if np.isfinite(s2) else 1.0
    group = list(range(n))

    def root(k: int) -> int:
        while group[k] != k:
            k = group[k]
        return k

    low = lambda f, k: (f.get(k) or "").strip().lower()
    for i in range(n):
        for j in range(i + 1, n):
            a, b = facts[i], facts[j]
            if (cfg.same_archive_only and low(a, "archive") != low(b, "archive")) or (cfg.same_proxy_only and low(a, "proxy") != low(b, "proxy")):
                continue
            placed = all(f.get(k) is not None and np.isfinite(f[k]) for f in (a, b) for k in ("lat", "lon"))
            close = placed and haversine((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= cfg.radius_km
            if not (cfg.radius_km > 0 and (close or any(low(a, k) and low(a, k) == low(b, k) for k in ("site", "source")))):
                continue
            ok = np.isfinite(fit[:, i]) & np.isfinite(fit[:, j])
            r = correlation(fit[ok, i], fit[ok, j])
            if ok.sum() >= cfg.min_overlap and np.isfinite(r) and abs(r) >= cfg.correlation:
                group[root(j)] = root(i)
    roots = [root(k) for k in range(n)]
    return np.clip(weight / np.array([roots.count(r) for r in roots]), cfg.minimum_weight, 1.0)
