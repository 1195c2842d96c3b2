"""Tails and quantiles of the Gamma, binomial and normal laws, for thresholds: scalars, made on the driver for few distinct arguments."""

import math

import numpy as np


def upper_gamma(shape: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below shape + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def mean_tail(x: float, shape: float) -> float:
    """P(the mean of so many unit exponentials > x)."""
    return upper_gamma(shape, x * shape)


def log10_mean_tail(x: float, shape: float) -> float:
    """log10 of mean_tail, far into the tail by the cube-root normal approximation."""
    try:
        p = mean_tail(x, shape)
    except OverflowError:
        p = 0.0
    if p > 1e-280:
        return math.log10(p)
    v = 1 / (9 * shape)
    z = (x ** (1 / 3) - (1 - v)) / math.sqrt(v)
    return (-z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / (z * z + 2))) / math.log(10)


def _where(p: float, tail, low: float, high: float) -> float:
    """Where a falling tail reaches p, by halving."""
    while tail(high) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > p else (low, mid)
    return (low + high) / 2


def mean_exceeded(p: float, shape: float) -> float:
    """The level that the mean of so many unit exponentials exceeds with probability p."""
    return _where(p, lambda x: mean_tail(x, shape), 0.0, 4.0)


def mean_quantile(q: float, shape: float) -> float:
    return mean_exceeded(1 - q, shape)


def normal_exceeded(p: float) -> float:
    """The level that a standard normal exceeds with probability p."""
    return -normal_exceeded(1 - p) if p > 0.5 else _where(p, lambda z: math.erfc(z / math.sqrt(2)) / 2, 0.0, 4.0)


def log_beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln of the regularised incomplete beta function I_x(a, b), by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = p * np.log(y) + q * np.where(swap, np.log(x), np.log1p(-x)) - np.log(p) - (_log_gamma(p) + _log_gamma(q) - _log_gamma(p + q))
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    most = 200 + int(10 * math.sqrt(float(np.max(np.minimum(p + q, 1e12), initial=1.0))))
    for m in range(1, most):
        for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    direct = np.minimum(front + np.log(h), 0.0)
    with np.errstate(divide="ignore"):
        return np.where(swap, np.log1p(-np.exp(np.minimum(direct, -1e-300))), direct)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def log_binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X binomial (n, p), element by element; time does not depend on n - k. 0 for k <= 0, -inf for k > n."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    out = np.zeros(k.shape)
    inside = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    out[(k > n) | ((k > 0) & (p <= 0))] = -np.inf
    if inside.any():
        out[inside] = log_beta_tail(k[inside], n[inside] - k[inside] + 1, p[inside])
    return out


def log_poisson_tail(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for X Poisson of a mean, element by element, far into the tail; 0 for k <= 0, -inf for a mean of 0 and k > 0."""
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    out = np.zeros(k.shape)
    out[(k > 0) & (mean <= 0)] = -np.inf
    some = np.flatnonzero((k > 0) & (mean > 0))
    a, x = k.ravel()[some], mean.ravel()[some]
    flat = out.ravel()
    # P(X >= k) is the lower incomplete gamma function: its series from the first term where terms fall, else one less the rest.
    far = x < a + 1
    term = np.ones(far.sum())
    total, n, b, y = term.copy(), 0, a[far], x[far]
    while len(term) and n < 100_000 and np.any(term > total * 1e-17):
        n += 1
        term = term * y / (b + n)
        total += term
    flat[some[far]] = np.minimum(0.0, b * np.log(y) - y - _log_gamma(b + 1) + np.log(total))
    near = ~far
    if near.any():
        below = np.array([upper_gamma(float(s), float(v)) for s, v in zip(a[near], x[near])])
        flat[some[near]] = np.log1p(-np.minimum(below, 1.0))
    return flat.reshape(k.shape)


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """ln of the number of ways to choose k of n; -inf outside."""
    n, k = np.broadcast_arrays(np.asarray(n, float), np.asarray(k, float))
    inside = (k >= 0) & (k <= n)
    m, j = np.where(inside, n, 0), np.where(inside, k, 0)
    return np.where(inside, _log_gamma(m + 1) - _log_gamma(j + 1) - _log_gamma(m - j + 1), -np.inf)


def log_sum(values: np.ndarray) -> float:
    """ln of the sum of exponentials; -inf for none."""
    top = float(np.max(values, initial=-np.inf))
    return top if not np.isfinite(top) else top + math.log(float(np.sum(np.exp(np.asarray(values) - top))))


def log_block_bound(length: int, distance: int, checks: int) -> float:
    """ln of a bound on the chance that a random word of so many bits lies within a distance of a code word of a code with so many checks: a ball about each code word."""
    return min(0.0, log_sum(log_choose(np.full(distance + 1, length), np.arange(distance + 1))) - checks * math.log(2))
