"""Synthetic light curves of five kinds, each a function of its seed alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Kinds, the class each belongs to, and the shares of a default population.
KINDS = {"transit": "transit", "eclipsing_binary": "eclipsing_binary", "blend": "blend", "variable": "other", "noise": "other"}
SHARES = {"transit": 0.30, "eclipsing_binary": 0.25, "blend": 0.15, "variable": 0.15, "noise": 0.15}
SCHEMA = "tic_id long, kind string, label string, seed long, time double, flux float, quality int, true_period double, true_depth double, true_duration double, true_t0 double, crowdsap double"


def white_noise(tmag: float) -> float:
    return float(np.clip(1.5e-4 * 10 ** (0.28 * (tmag - 8)), 5e-5, 5e-2))


def red_noise(t: np.ndarray, size: float, rng: np.random.Generator) -> np.ndarray:
    """Slow waves and a first-order autoregression, three to two."""
    waves = sum(rng.uniform(0.3, 1) * np.sin(2 * np.pi * t / rng.uniform(1, 12) + rng.uniform(0, 6.28)) for _ in range(rng.integers(2, 5)))
    phi, e = rng.uniform(0.85, 0.98), rng.normal(size=len(t))
    ar = np.empty(len(t))
    last = 0.0
    for i, x in enumerate(e):
        last = phi * last + x
        ar[i] = last
    unit = lambda x: x / max(float(np.std(x)), 1e-12)
    return size * (0.6 * unit(waves) + 0.4 * unit(ar))


def light_curve(kind: str, seed: int, days: float = 27.4, minutes: float = 2.0) -> dict[str, object]:
    """time, flux, quality and the injected truth; one mid-series gap, a few steps and outliers."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    rng = np.random.default_rng(seed)
    start = 1325 + rng.uniform(0, 5)
    t = start + np.arange(0, days, minutes / 1440)
    tmag = rng.uniform(8, 12)
    sigma, crowd = white_noise(tmag), 1.0 if kind != "blend" else rng.uniform(0.3, 0.8)
    period = rng.uniform(1.0, max(1.2, min(days / 3, 9.0)))
    duration = float(np.clip(0.08 * period ** (1 / 3) * rng.uniform(0.9, 1.6), 0.02, min(0.6, 0.2 * period)))
    t0 = start + rng.uniform(0.2, 0.8) * period
    flux, depth = np.ones(len(t)), 0.0
    dt = ((t - t0) / period + 0.5) % 1.0 - 0.5
    cycle = np.floor((t - t0) / period + 0.5)
    x = np.abs(dt * period) / (duration / 2)
    if kind == "transit":
        depth = rng.uniform(0.002, 0.015)
        mu = np.sqrt(np.maximum(1 - x**2, 0))
        flux -= np.where(x < 1, depth * (0.75 + 0.25 * mu) * np.clip((1 - x) / 0.15, 0, 1), 0)
    elif kind in ("eclipsing_binary", "blend"):
        depth = rng.uniform(0.05, 0.3) if kind == "eclipsing_binary" else rng.uniform(0.02, 0.1) * crowd
        odd = rng.uniform(0.75, 0.95)
        flux -= np.where(x < 1, depth * (1 - x), 0) * np.where(cycle % 2 == 1, odd, 1.0)
        y = np.abs((((t - t0) / period) % 1.0 - 0.5) * period) / (duration / 2)
        flux -= np.where(y < 1, depth * rng.uniform(0.3, 0.9) * (1 - y), 0)
    elif kind == "variable":
        flux += rng.uniform(0.002, 0.02) * np.sin(2 * np.pi * t / rng.uniform(0.5, 8) + rng.uniform(0, 6.28))
    flux += rng.normal(0, sigma, len(t)) + red_noise(t, 0.3 * sigma, rng)
    out = rng.choice(len(t), min(rng.poisson(0.002 * len(t)), len(t)), replace=False)
    flux[out] += np.where(rng.random(len(out)) < 0.75, 1, -1) * rng.uniform(5, 12, len(out)) * sigma
    quality = np.zeros(len(t), int)
    for _ in range(rng.integers(1, 4)):
        at = int(rng.integers(len(t)))
        flux[at:] += rng.normal(0, 0.3 * sigma)
        quality[max(at - 3, 0) : at + 3] |= 0x20
    width = int(rng.uniform(0.02, 0.05) * len(t))
    middle = int(len(t) * rng.uniform(0.4, 0.6))
    keep = np.ones(len(t), bool)
    keep[middle : middle + width] = False
    has = depth > 0
    return {"time": t[keep], "flux": flux[keep].astype(np.float32), "quality": quality[keep], "label": KINDS[kind], "true_period": period if has else None, "true_depth": depth if has else None, "true_duration": duration if has else None, "true_t0": t0 if has else None, "crowdsap": crowd}


def population(n: int, seed: int = 0, shares: dict[str, float] | None = None) -> list[tuple[str, int]]:
    """(kind, seed) of n stars in shuffled order; counts by the largest remainders."""
    shares = shares or SHARES
    total = sum(shares.values())
    if total <= 0 or n < 0:
        raise ValueError("shares must add up to more than zero")
    exact = {k: n * v / total for k, v in shares.items()}
    counts = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (counts[k] - exact[k], list(shares).index(k)))[: n - sum(counts.values())]:
        counts[k] += 1
    rng = np.random.default_rng(seed)
    kinds = [k for k, c in counts.items() for _ in range(c)]
    rng.shuffle(kinds)
    return list(zip(kinds, rng.integers(0, 2**31 - 1, n).tolist(), strict=True))


def generate(spark: SparkSession, stars: list[tuple[str, int]], days: float = 27.4, minutes: float = 2.0) -> DataFrame:
    """All stars' points in long form; only (kind, seed) leave the driver."""
    seeds = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(stars)], "tic_id long, kind string, seed long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                yield pd.DataFrame({"tic_id": r.tic_id, "kind": r.kind, "seed": r.seed, **light_curve(r.kind, r.seed, days, minutes)})[[c.split()[0] for c in SCHEMA.split(", ")]]

    return seeds.repartition(min(max(len(stars), 1), 64), "tic_id").mapInPandas(run, SCHEMA)
