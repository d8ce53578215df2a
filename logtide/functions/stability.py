"""Spread of a metric over repeated runs."""

from __future__ import annotations

import random
import statistics


def bootstrap(values: list[float], name: str = "", seed: int = 7, resamples: int = 10_000, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean; the seed follows the metric's name."""
    if not values:
        raise ValueError("no values")
    rng = random.Random(seed + sum((i + 1) * ord(c) for i, c in enumerate(name)))
    n = len(values)
    means = sorted(sum(rng.choice(values) for _ in range(n)) / n for _ in range(resamples))
    cut = (1 - level) / 2
    return means[int(cut * (resamples - 1))], means[int((1 - cut) * (resamples - 1))]


def summarise(values: list[float], name: str = "", seed: int = 7) -> dict:
    lo, hi = bootstrap(values, name, seed)
    return {"mean": statistics.fmean(values), "std": statistics.stdev(values) if len(values) > 1 else 0.0, "min": min(values), "max": max(values), "ci_low": lo, "ci_high": hi}
