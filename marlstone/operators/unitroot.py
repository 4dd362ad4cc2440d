"""Augmented Dickey-Fuller test and MacKinnon p-values for one short series, used inside grouped jobs.

The lag count is chosen by AIC on a common sample and the regression is then run again on the longest one. The p-value is the
normal distribution of a polynomial in the statistic (MacKinnon 1994, constant case).
"""

from __future__ import annotations

import math

import numpy as np

#: Fixed values by number of series N: where the polynomials meet, the lower and upper clamp, and the coefficients below and above.
SURFACE = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def mackinnon_p(statistic: float, series: int = 1) -> float:
    meet, low, high, small, large = SURFACE[series]
    if statistic > high:
        return 1.0
    if statistic < low:
        return 0.0
    z = sum(c * statistic**k for k, c in enumerate(small if statistic <= meet else large))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[float, float] | None:
    """(t-statistic of the first regressor, AIC), or None for a singular design."""
    n, k = x.shape
    if n <= k or np.linalg.matrix_rank(x) < k:
        return None
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ (x.T @ y)
    rss = float(((y - x @ beta) ** 2).sum())
    if rss <= 0:
        return None
    likelihood = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    return float(beta[0] / math.sqrt(rss / (n - k) * inverse[0, 0])), 2 * k - 2 * likelihood


def adf(series: np.ndarray, constant: bool = True, lags: int | None = None) -> tuple[float, int, int] | None:
    """(statistic, lags, observations); None where the series is too short or singular."""
    n = len(series)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - int(constant) - 1)
    if most < 0:
        return None
    step = np.diff(series)

    def design(p: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
        y = step[drop:]
        columns = [series[drop:-1], *[step[drop - j : len(step) - j] for j in range(1, p + 1)]]
        return y, np.column_stack([*columns, np.ones(len(y))] if constant else columns)

    if lags is None:
        tried = [(r[1], p) for p in range(most + 1) if (r := _fit(*design(p, most)))]
        if not tried:
            return None
        lags = min(tried)[1]
    y, x = design(lags, lags)
    r = _fit(y, x)
    return None if r is None else (r[0], lags, len(y))


def integrated(series: np.ndarray, level: float = 0.05) -> bool:
    """I(1): the level has a unit root and its difference hasn't."""
    a, b = adf(series), adf(np.diff(series))
    return bool(a and b and mackinnon_p(a[0]) > level and mackinnon_p(b[0]) <= level)
