"""log-gamma and digamma for numpy arrays, by recurrence to large arguments and the asymptotic series; the logarithm of the
modified Bessel function of the first kind, and the concentration of directions that it gives."""

from __future__ import annotations

import numpy as np


def digamma(x):
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = out - np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def lgamma(x):
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = out - np.where(low, np.log(x), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y / 1260)) / x


def log_bessel_i(order, x):
    """ln I_order(x) for orders >= 0 and x > 0, of any shapes that match. Up to 2,000 by the power series, whose terms are all
    positive, summed in logarithms; beyond by the expansion that is uniform in the order."""
    order, x = np.broadcast_arrays(np.asarray(order, float), np.asarray(x, float))
    out = np.empty(x.shape)
    small = x <= 2000
    if small.any():
        v, z = order[small], x[small]
        k = np.arange(1, int(z.max()) + 64)
        out_small = np.empty(len(z))
        for lo in range(0, len(z), 512):  # so many at a time
            a, b = v[lo : lo + 512, None], z[lo : lo + 512, None]
            logs = np.cumsum(2 * np.log(b / 2) - np.log(k) - np.log(a + k), axis=1)
            top = np.maximum(logs.max(1), 0)
            out_small[lo : lo + 512] = top + np.log(np.exp(-top) + np.exp(logs - top[:, None]).sum(1))
        out[small] = out_small + v * np.log(z / 2) - lgamma(v + 1)
    if (~small).any():
        v, z = order[~small], x[~small]
        root = np.hypot(v, z)
        p, q = v / root, 1 / root  # q is p / order, which stays finite at order 0
        terms = q * (3 - 5 * p**2) / 24 + q**2 * (81 - 462 * p**2 + 385 * p**4) / 1152 + q**3 * (30375 - 369603 * p**2 + 765765 * p**4 - 425425 * p**6) / 414720
        out[~small] = root + v * np.log(z / (v + root)) - 0.5 * np.log(2 * np.pi * root) + np.log1p(terms)
    return out


def concentration(r, d: int):
    """kappa at which directions in d dimensions have mean length r (0 <= r < 1): Newton steps on the ratio of Bessel
    functions, from the closed approximation."""
    r = np.atleast_1d(np.asarray(r, float))
    kappa = np.maximum(r * (d - r * r) / (1 - r * r), 1e-12)
    for _ in range(50):
        ratio = np.exp(log_bessel_i(d / 2, kappa) - log_bessel_i(d / 2 - 1, kappa))
        slope = 1 - ratio * ratio - (d - 1) / kappa * ratio
        step = (ratio - r) / np.maximum(slope, 1e-300)
        kappa = np.where(kappa - step > 0, kappa - step, kappa / 2)
        if np.all(np.abs(step) <= 1e-12 * kappa):
            break
    return np.where(r <= 0, 0.0, kappa)
