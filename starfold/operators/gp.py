"""Gaussian-process trends: a damped oscillator as a semiseparable kernel, solved in time linear in the points.

The kernel is sigma^2 exp(-c x) (cos c x + sin c x) with c = sqrt(2) pi / rho, a
stochastically driven oscillator of quality 1 / sqrt(2).  Its matrix is a
diagonal plus products of rank two on either side, which a Cholesky
factorisation keeps: one sweep over the points factors it and solves, one back
gives the posterior mean.
"""

from __future__ import annotations

import math

import numpy as np


def solve(t: np.ndarray, y: np.ndarray, noise: float | np.ndarray, sigma: float, rho: float) -> tuple[np.ndarray, float]:
    """Posterior mean at the points themselves, and the log likelihood of ``y`` (of mean 0) at ascending ``t``.

    A matrix that is not positive in floating point raises ArithmeticError.
    """
    n = len(t)
    c, variance = math.sqrt(2) * math.pi / rho, sigma * sigma
    noise2 = np.broadcast_to(np.asarray(noise, float) ** 2, n)
    angle = c * (t - t[0])
    cos, sin = np.cos(angle), np.sin(angle)
    v1, v2 = cos.tolist(), sin.tolist()
    u1, u2 = (variance * (cos + sin)).tolist(), (variance * (sin - cos)).tolist()
    fall = np.exp(-c * np.diff(t, prepend=t[:1])).tolist()
    diagonal, given = (variance + noise2).tolist(), y.tolist()
    w1, w2, z, d = [0.0] * n, [0.0] * n, [0.0] * n, [1.0] * n
    s11 = s12 = s22 = f1 = f2 = a1 = a2 = before = 0.0
    scale = 1.0
    for i in range(n):
        p, b1, b2 = fall[i], u1[i], u2[i]
        p2 = p * p
        s11 = p2 * (s11 + scale * a1 * a1)
        s12 = p2 * (s12 + scale * a1 * a2)
        s22 = p2 * (s22 + scale * a2 * a2)
        q1, q2 = b1 * s11 + b2 * s12, b1 * s12 + b2 * s22
        scale = diagonal[i] - q1 * b1 - q2 * b2
        if not scale > 0:
            raise ArithmeticError("the kernel's matrix is not positive")
        f1, f2 = p * (f1 + a1 * before), p * (f2 + a2 * before)
        a1, a2 = (v1[i] - q1) / scale, (v2[i] - q2) / scale
        before = given[i] - b1 * f1 - b2 * f2
        w1[i], w2[i], z[i], d[i] = a1, a2, before, scale
    zs, ds = np.array(z), np.array(d)
    likelihood = -0.5 * float((zs * zs / ds + np.log(ds)).sum() + n * math.log(2 * math.pi))
    g1 = g2 = 0.0
    alpha = (zs / ds).tolist()
    for i in range(n - 1, -1, -1):
        a = alpha[i] - w1[i] * g1 - w2[i] * g2
        alpha[i] = a
        p = fall[i]
        g1, g2 = p * (g1 + u1[i] * a), p * (g2 + u2[i] * a)
    return y - noise2 * np.array(alpha), likelihood


def likelihoods(t: np.ndarray, f: np.ndarray, rhos: np.ndarray, sigma: float, noise: float) -> np.ndarray:
    """Log likelihood of the curve about its median at each scale; -inf where the matrix is not positive."""
    out = np.full(len(rhos), -np.inf)
    for i, rho in enumerate(rhos):
        try:
            out[i] = solve(t, f - np.median(f), noise, sigma, float(rho))[1]
        except ArithmeticError:
            pass
    return out


def settings(t: np.ndarray, f: np.ndarray, window: float, error: np.ndarray | None, scatter: float) -> tuple[float, float, float]:
    """sigma, rho and noise: the robust scatter, the window (five steps at least), and the median error or else the scatter."""
    usual = float(np.nanmedian(error)) if error is not None and np.isfinite(error).any() else float("nan")
    noise = usual if np.isfinite(usual) and usual > 0 else scatter or 1e-3
    return scatter or 1e-3, max(window, 5 * float(np.median(np.diff(t)))), noise


def trend(t: np.ndarray, f: np.ndarray, window: float, error: np.ndarray | None, scatter: float, scales: tuple[float, ...] = (1.0,)) -> np.ndarray:
    """The posterior mean under the scale of greatest likelihood among ``scales`` times the window.

    Scales below 1 would let the trend follow dips, so the search is meant to go upwards.
    """
    sigma, rho, noise = settings(t, f, window, error, scatter)
    rhos = rho * np.asarray(scales, float)
    best = rhos[int(np.argmax(likelihoods(t, f, rhos, sigma, noise)))] if len(rhos) > 1 else rhos[0]
    middle = float(np.median(f))
    return middle + solve(t, f - middle, noise, sigma, float(best))[0]
