"""Numpy kernels of one series: decomposition by loess, unit-root and level tests, partial autocorrelation, Box-Cox."""

from __future__ import annotations

import math

import numpy as np

from .distributions import chi2_sf, f_sf, mackinnon_p


def _loess(y: np.ndarray, window: int, at: np.ndarray, robust: np.ndarray | None) -> np.ndarray:
    """Local linear fits of equally spaced values (positions 0..n-1) with tricube weights."""
    n = len(y)
    q = min(window, n)
    left = np.clip(np.round(at - (q - 1) / 2).astype(int), 0, n - q)
    idx = left[:, None] + np.arange(q)[None, :]
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1) + (max(0, window - n) // 2 if window > n else 0)
    w = np.clip(1 - (dist / np.maximum(reach, 1e-12)[:, None] / 1.0) ** 3, 0, None) ** 3
    if robust is not None:
        w = w * robust[idx]
    total = w.sum(axis=1)
    w = np.where(total[:, None] > 0, w / np.maximum(total, 1e-300)[:, None], 1.0 / q)
    centre = (w * idx).sum(axis=1)
    gap = idx - centre[:, None]
    spread = (w * gap**2).sum(axis=1)
    slope = np.where(np.sqrt(spread) > 1e-3 * max(n - 1, 1) * 1e-3, (w * gap * y[idx]).sum(axis=1) / np.maximum(spread, 1e-300), 0.0)
    return (w * y[idx]).sum(axis=1) + slope * (at - centre)


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate(([0.0], x)))
    return (c[k:] - c[:-k]) / k


def _odd(x: float) -> int:
    k = math.ceil(x)
    return k if k % 2 else k + 1


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual) of Cleveland et al., 1990, with degree 1."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 2 * period:
        raise ValueError("a series of two periods at least")
    trend_w, low_w = _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1)
    trend, season, weights = np.zeros(n), np.zeros(n), None
    for _ in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            rest = y - trend
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                own = rest[p::period]
                cycle[p::period] = _loess(own, seasonal, np.arange(-1.0, len(own) + 1), None if weights is None else weights[p::period])
            low = _loess(_moving(_moving(_moving(cycle, period), period), 3), low_w, np.arange(float(n)), None)
            season = cycle[period : n + period] - low
            trend = _loess(y - season, trend_w, np.arange(float(n)), weights)
        if robust:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            weights = np.ones(n) if h == 0 else np.where(r <= 0.001 * h, 1.0, np.where(r >= 0.999 * h, 0.0, (1 - (r / h) ** 2) ** 2))
    return trend, season, y - trend - season


def classical(y: np.ndarray, period: int, extend: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Additive classical decomposition; ``extend`` continues the trend by lines over one period at each end."""
    n = len(y)
    k = np.ones(period) / period if period % 2 else np.concatenate(([0.5], np.ones(period - 1), [0.5])) / period
    trend = np.full(n, np.nan)
    half = len(k) // 2
    trend[half : n - half] = np.convolve(y, k, "valid")
    if extend:
        ok = np.flatnonzero(~np.isnan(trend))
        for part, gap in ((ok[:period], np.arange(0, ok[0])), (ok[-period:], np.arange(ok[-1] + 1, n))):
            b, a = np.polyfit(part, trend[part], 1)
            trend[gap] = a + b * gap
    gap = y - trend
    phase = np.array([np.nanmean(gap[p::period]) for p in range(period)])
    season = (phase - phase.mean())[np.arange(n) % period]
    return trend, season, y - trend - season


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors, and the residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    ssr = float(e @ e)
    s2 = ssr / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ x)) * s2, 0)), ssr


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    d = np.diff(y)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(d))
        cols = [y[rows], *[d[rows - i] for i in range(1, lags + 1)], np.ones(len(rows))]
        return np.column_stack(cols), d[rows]

    best, lags = math.inf, 0
    for k in range(most + 1):
        x, t = design(k, most)
        _, _, ssr = _ols(x, t)
        m = len(t)
        aic = m * (math.log(2 * math.pi * max(ssr, 1e-300) / m) + 1) + 2 * x.shape[1]
        if aic < best:
            best, lags = aic, k
    x, t = design(lags, lags)
    beta, se, _ = _ols(x, t)
    tau = float(beta[0] / se[0]) if se[0] else -math.inf
    return tau, mackinnon_p(tau), lags


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, lags) of level stationarity; p is interpolated in and clipped to [0.01, 0.10]."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    e = y - y.mean()
    cover = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, cover + 1):
        c = float(e[i:] @ e[:-i]) / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))) if s0 else 0
    var = float(e @ e) / n + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n**2 * var)) if var > 0 else 0.0
    # The published critical values.
    return stat, float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01])), lags


def phillips_perron(y: np.ndarray) -> tuple[float, float, int]:
    """(Z-tau, p, lags) with a constant and Bartlett weights."""
    y = np.asarray(y, dtype=float)
    x = np.column_stack([y[:-1], np.ones(len(y) - 1)])
    beta, se, ssr = _ols(x, y[1:])
    e, n = y[1:] - x @ beta, len(y) - 1
    lags = math.ceil(12 * (n / 100) ** 0.25)
    g0 = ssr / n
    lam = g0 + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, min(lags, n - 1) + 1))
    s = math.sqrt(ssr / (n - 2))
    tau = (beta[0] - 1) / se[0]
    z = float(math.sqrt(g0 / lam) * tau - (lam - g0) * n * se[0] / (2 * math.sqrt(lam) * s))
    return z, mackinnon_p(z), lags


def pacf_from_acf(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 0.. by Levinson and Durbin."""
    out, phi, v = [1.0], np.zeros(0), 1.0
    for k in range(1, len(r)):
        a = (r[k] - phi @ r[1:k][::-1]) / v if v > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(float(a))
    return np.array(out)


def boxcox_lambda(x: np.ndarray) -> float:
    """The power of largest profile likelihood, by golden section in [-2, 5]."""
    logs = np.log(x)
    total, n = logs.sum(), len(x)

    def loss(lam: float) -> float:
        t = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
        return -((lam - 1) * total - n / 2 * math.log(max(t.var(), 1e-300)))

    low, high, g = -2.0, 5.0, (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    while high - low > 1e-8:
        if loss(a) < loss(b):
            high, b, a = b, a, b - g * (b - low)
        else:
            low, a, b = a, b, a + g * (high - a)
    return (low + high) / 2


def boxcox(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x) if abs(lam) < 1e-12 else np.expm1(lam * np.log(x)) / lam


def granger(cause: np.ndarray, effect: np.ndarray, lag: int) -> dict[str, float]:
    """P-values of the four usual statistics that lags of ``cause`` help to predict ``effect``, and both residual sums."""
    n = len(effect)
    rows = np.arange(lag, n)
    own = [effect[rows - i] for i in range(1, lag + 1)]
    other = [cause[rows - i] for i in range(1, lag + 1)]
    one = np.ones(len(rows))
    _, _, ssr_r = _ols(np.column_stack([*own, one]), effect[rows])
    x = np.column_stack([*own, *other, one])
    _, _, ssr_u = _ols(x, effect[rows])
    m, dof = len(rows), len(rows) - x.shape[1]
    gain = max(0.0, ssr_r - ssr_u)
    f = gain / lag / (ssr_u / dof) if ssr_u > 0 and dof > 0 else math.inf
    ratio = m * math.log(ssr_r / ssr_u) if ssr_u > 0 else math.inf
    return {"ssr_r": ssr_r, "ssr_u": ssr_u, "ssr_chi2test": chi2_sf(m * gain / ssr_u, lag) if ssr_u > 0 else 0.0, "ssr_ftest": f_sf(f, lag, dof), "lrtest": chi2_sf(ratio, lag) if ratio < math.inf else 0.0, "params_ftest": f_sf(f, lag, dof)}
