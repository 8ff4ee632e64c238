"""Distribution functions with NumPy alone, vectorised; tested against tabulated values."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def lgamma(x):
    return _lgamma(np.asarray(x, float))


def norm_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p):
    """Quantile by bisection refined with Newton steps."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -39.0), np.full(p.shape, 39.0)
    for _ in range(70):
        mid = (lo + hi) / 2
        low = np.where(mid < 0, norm_cdf(mid) < p, norm_sf(mid) > 1 - p)
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    out = (lo + hi) / 2
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


def betainc(a, b, x):
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    shape = a.shape
    a, b, x = (np.atleast_1d(v).ravel().copy() for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a2, b2, x2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a2 * np.log(x2) + b2 * np.log1p(-x2) - (lgamma(a2) + lgamma(b2) - lgamma(a2 + b2))) / a2
    tiny = 1e-300
    c, d = np.ones_like(a2), 1 - (a2 + b2) * x2 / (a2 + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for num in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where(x2 <= 0, 0.0, front * f)
    out = np.where(swap, 1 - out, out)
    return np.where(np.isnan(x), np.nan, np.clip(out, 0, 1)).reshape(shape)


def gammainc(a, x):
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    shape = a.shape
    a, x = np.atleast_1d(a).ravel().copy(), np.atleast_1d(x).ravel().copy()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scale = np.exp(-x + a * np.log(x) - lgamma(a))
    term, total, k = 1 / a, 1 / a, a.copy()
    for _ in range(2000):
        k = k + 1
        term = term * x / k
        total = total + term
        if np.all((np.abs(term) < np.abs(total) * 1e-16) | (x > a + 1)):
            break
    low = scale * total
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x <= a + 1)):
            break
    out = np.where(x <= 0, 0.0, np.where(x < a + 1, low, 1 - scale * h))
    return np.clip(out, 0, 1).reshape(shape)


def t_sf(t, df):
    """Upper tail of Student's t; infinite df is the normal distribution."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    safe = np.where(np.isfinite(df), df, 1.0)
    with np.errstate(over="ignore"):
        tail = 0.5 * betainc(safe / 2, 0.5, safe / (safe + np.where(np.isfinite(t), t, 0.0) ** 2))
    tail = np.where(np.isinf(t), 0.0, tail)
    out = np.where(t > 0, tail, 1 - tail)
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.where(np.isinf(df), norm_sf(t), out))


def t_cdf(t, df):
    return t_sf(-np.asarray(t, float), df)


def t_two_sided(t, df):
    return 2 * t_sf(np.abs(np.asarray(t, float)), df)


def t_ppf(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, -1e8), np.full(p.shape, 1e8)
    for _ in range(110):
        mid = (lo + hi) / 2
        low = t_cdf(mid, df) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, k):
    return 1 - gammainc(np.asarray(k, float) / 2, np.asarray(x, float) / 2)


def digamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(12):
        small = y < 12
        shift = np.where(small, shift - 1 / np.where(small, y, 1), shift)
        y = np.where(small, y + 1, y)
    i = 1 / (y * y)
    return shift + np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132 - i * 691 / 32760)))))


def trigamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(12):
        small = y < 12
        shift = np.where(small, shift + 1 / np.where(small, y, 1) ** 2, shift)
        y = np.where(small, y + 1, y)
    i = 1 / (y * y)
    return shift + 1 / y + i / 2 + i / y * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * (5 / 66 - i * 691 / 2730)))))


def tetragamma(x):
    """Derivative of trigamma, by a central difference that is exact enough for Newton steps."""
    h = 1e-4 * np.maximum(1.0, np.abs(x))
    return (trigamma(x + h) - trigamma(x - h)) / (2 * h)


def trigamma_inverse(y: float, tol: float = 1e-8, max_iter: int = 50) -> float:
    """The x with trigamma(x) = y, by Newton's method on 1 / trigamma."""
    if not y > 0:
        return math.inf if y == 0 else math.nan
    if y > 1e7:
        return 1 / math.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(max_iter):
        tri = float(trigamma(x))
        step = tri * (1 - tri / y) / float(tetragamma(x))
        x += step
        if -step / x < tol:
            break
    return x


def log_choose(n, k):
    return lgamma(np.asarray(n, float) + 1) - lgamma(np.asarray(k, float) + 1) - lgamma(np.asarray(n, float) - np.asarray(k, float) + 1)


def hypergeom_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) marked among drawn of total."""
    top = min(marked, drawn)
    if k <= max(0, drawn + marked - total):
        return 1.0
    if k > top:
        return 0.0
    x = np.arange(k, top + 1)
    return float(min(1.0, np.exp(log_choose(marked, x) + log_choose(total - marked, drawn - x) - log_choose(total, drawn)).sum()))


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else float(betainc(k, n - k + 1, p))


def mann_whitney(a, b) -> tuple[float, float]:
    """U of a and the two-sided normal approximation with tie and continuity correction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    x = np.concatenate([a, b])
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    u = ranks[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    n = len(x)
    sd = math.sqrt(max(0.0, len(a) * len(b) / 12 * (n + 1 - (counts**3 - counts).sum() / max(1, n * (n - 1)))))
    if not sd:
        return float(u), 1.0
    z = (abs(u - len(a) * len(b) / 2) - 0.5) / sd
    return float(u), float(min(1.0, 2 * norm_sf(max(0.0, z))))
