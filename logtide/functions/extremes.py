"""Extreme value fits: GEV by L-moments, GPD by likelihood; plain numbers in and out."""

from __future__ import annotations

import math

import numpy as np

EULER = 0.57721566


def gev_shape(t3: float) -> float:
    """Hosking's rational approximation of the shape k from the L-skewness; Newton below -0.8."""
    if t3 > 0:
        z = 1 - t3
        return (-1 + z * (1.59921491 + z * (-0.48832213 + 0.01573152 * z))) / (1 + z * (-0.64363929 + 0.08985247 * z))
    k = (0.28377530 + t3 * (-1.21096399 + t3 * (-2.50728214 + t3 * (-1.13455566 - 0.07138022 * t3)))) / (1 + t3 * (2.06189696 + t3 * (1.31912239 + 0.25077104 * t3)))
    if t3 < -0.8:
        for _ in range(20):
            f = 2 * (1 - 3**-k) / (1 - 2**-k) - 3 - t3
            slope = 2 * (3**-k * math.log(3) * (1 - 2**-k) - (1 - 3**-k) * 2**-k * math.log(2)) / (1 - 2**-k) ** 2
            k -= f / slope
            if abs(f) < 1e-10:
                break
    return k


def gev_from_moments(l1: float, l2: float, t3: float, alpha: float) -> tuple[float, float, float, float]:
    """(shape, loc, scale, upper quantile at ``alpha``)."""
    k = gev_shape(t3)
    if abs(k) < 1e-5:
        scale = l2 / math.log(2)
        loc = l1 - EULER * scale
        return 0.0, loc, scale, loc - scale * math.log(-math.log(alpha))
    g = math.gamma(1 + k)
    scale = l2 * k / (g * (1 - 2**-k))
    loc = l1 - scale * (1 - g) / k
    return k, loc, scale, loc + scale / k * (1 - (-math.log(alpha)) ** k)


def sample_l_moments(values) -> tuple[float, float, float]:
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        raise ValueError("at least three values are needed")
    i = np.arange(n)
    b0, b1 = x.mean(), (i * x).sum() / (n * (n - 1))
    b2 = (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2))
    l2 = 2 * b1 - b0
    return float(b0), float(l2), float((6 * b2 - 6 * b1 + b0) / l2) if l2 else 0.0


def gpd_thetas(mean: float, top: float) -> np.ndarray:
    """The values of shape / scale at which the profile likelihood is looked at."""
    return np.concatenate([-np.linspace(1e-6, 0.999, 400) / top, np.geomspace(1e-6, 1e3, 800) / mean])


def gpd_profile(n: float, mean: float, thetas: np.ndarray, shapes: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of greatest likelihood; ``shapes`` are the means of log1p(theta * excess) over all ``n`` excesses."""
    best = (-n * (math.log(mean) + 1), 0.0, mean)  # exponential
    for theta, xi in zip(thetas.tolist(), shapes.tolist(), strict=True):
        if xi < -0.5 or xi == 0 or xi / theta <= 0:
            continue
        sigma = xi / theta
        value = -n * (math.log(sigma) + xi + 1)
        if value > best[0]:
            best = (value, xi, sigma)
    return best[1], best[2]


def gpd_fit(excess) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto law at 0 by maximum likelihood (Grimshaw's one-parameter profile), shape at least -0.5."""
    x = np.asarray(excess, float)
    x = x[x > 0]
    if not len(x):
        raise ValueError("no exceedances")
    thetas = gpd_thetas(x.mean(), x.max())
    return gpd_profile(len(x), x.mean(), thetas, np.array([np.log1p(t * x).mean() for t in thetas]))


def pot_fit(values, quantile: float = 0.95, tail: float = 0.1) -> dict:
    """Peaks over threshold: u is the lower-index order statistic, z the ``1 - tail`` quantile of the excesses above it."""
    x = np.sort(np.asarray(values, float))
    if not len(x):
        raise ValueError("no values")
    u = float(x[int((len(x) - 1) * quantile)])
    over = x[x > u]
    if not len(over):
        raise ValueError("no exceedances")
    xi, sigma = gpd_fit(over - u)
    z = u + (sigma / xi * (tail**-xi - 1) if abs(xi) > 1e-9 else -sigma * math.log(tail))
    return {"threshold_u": u, "threshold_z": z, "gpd_shape": xi, "gpd_scale": sigma, "num_exceedances": len(over)}
