"""Closing p-values and exact limits on NumPy arrays, wrapped as vectorised functions.

They run on the rows of an aggregated table.  No SciPy: the incomplete gamma function uses
its series, its continued fraction or the uniform large-order expansion; the tails of Fisher's
test and binomial quantiles sum ratios of neighbours for all rows of a batch at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(fn, x) -> np.ndarray:
    """A scalar math function over an array."""
    x = np.asarray(x, dtype=float)
    return np.fromiter(map(fn, x.ravel()), float, x.size).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def gammaln(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0: Stirling's series from 15 upwards, math.lgamma below."""
    x = np.asarray(x, dtype=float)
    big = np.maximum(x, 15.0)
    z = 1.0 / (big * big)
    tail = (1 / 12.0 - z * (1 / 360.0 - z * (1 / 1260.0 - z / 1680.0))) / big
    out = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + tail
    small = x < 15.0
    if np.any(small):
        out = np.where(small, _lgamma(np.where(small, x, 15.0)), out)
    return out


def _upper_gamma_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Uniform expansion of Q(a, x) for large a, two orders."""
    lam = x / a
    mu = lam - 1.0
    half_eta2 = np.where(np.abs(mu) < 1e-4, mu * mu / 2 - mu**3 / 3, mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2 * np.maximum(half_eta2, 0.0))
    near = np.abs(eta) < 0.3
    c0_near = -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835
    safe = np.where(near, 1.0, eta)
    c0 = np.where(near, c0_near, 1 / np.where(near, 1.0, mu) - 1 / safe)
    c1 = np.where(near, -1 / 540 - eta / 288 + eta**2 / 378, 0.0)
    rest = np.exp(-a * half_eta2) / np.sqrt(2 * math.pi * a) * (c0 + c1 / a)
    return np.clip(0.5 * _erfc(eta * np.sqrt(a / 2)) + rest, 0.0, 1.0)


def gammaincc(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    todo = (x > 0) & (a > 0)
    huge = todo & (a > 1e4)
    if huge.any():
        out[huge] = _upper_gamma_large(a[huge], x[huge])
    series = todo & ~huge & (x < a + 1)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1.0 / aa
        total, n = term.copy(), aa.copy()
        for _ in range(20000):
            n += 1
            term = term * xx / n
            total += term
            if np.all(term < total * 1e-17):
                break
        out[series] = 1.0 - total * np.exp(-xx + aa * np.log(xx) - gammaln(aa))
    fraction = todo & ~huge & ~series
    if fraction.any():
        aa, xx = a[fraction], x[fraction]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full_like(b, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 20000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[fraction] = np.exp(-xx + aa * np.log(xx) - gammaln(aa)) * h
    out[np.isnan(a) | np.isnan(x)] = np.nan
    return out


def gamma_quantile(p: float, a) -> np.ndarray:
    """x with P(a, x) = p, by bisection on a Wilson-Hilferty bracket; 0 where a <= 0."""
    a = np.asarray(a, float)
    aa = np.where(a > 0, a, 1.0)
    lo = np.zeros_like(aa)
    hi = aa + 12 * np.sqrt(aa) + 40
    target = 1.0 - p
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        right = gammaincc(aa, mid) > target
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
        if np.all(hi - lo <= 1e-15 * hi):
            break
    return np.where(a > 0, 0.5 * (lo + hi), 0.0)


def chi2_sf_array(x, dof) -> np.ndarray:
    x, dof = np.asarray(x, float), np.asarray(dof, float)
    return np.where(np.isnan(x) | (dof <= 0), np.nan, gammaincc(dof / 2, np.maximum(x, 0) / 2))


def _log_choose(n, k):
    return gammaln(n + 1.0) - gammaln(k + 1.0) - gammaln(n - k + 1.0)


#: Cells of a block of padded ranges, and the widest range that is laid out whole.
_BLOCK_CELLS, _WIDEST = 1 << 21, 1 << 20


def _by_width(width: np.ndarray):
    """Rows in blocks of about equal width: (rows, columns).  A row's sums do not depend on its block."""
    level = np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64)
    for k in np.unique(level):
        rows = np.flatnonzero(level == k)
        step = max(1, _BLOCK_CELLS >> int(k))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, int(width[part].max())


def _hypergeometric_log_ratio(x, n1, n2, m1):
    """log P(x + 1) / P(x) for the upper left cell of a table with fixed margins; -inf outside."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = (n1 - x) * (m1 - x)
        down = (x + 1) * (n2 - m1 + x + 1)
        return np.where((up > 0) & (down > 0), np.log(up) - np.log(down), -np.inf)


def _tails(start, step, first, n1, n2, m1, length) -> np.ndarray:
    """Sums of P(start), P(start + step), ... for many tables, given P(start) as ``first``."""
    out = np.zeros(len(start))
    for rows, width in _by_width(length):
        s, d, n = start[rows][:, None], step[rows][:, None], length[rows][:, None]
        at = np.arange(width)
        x = s + d * at
        # The step from x to x + d, read upwards or downwards.
        low = np.minimum(x, x + d)
        ratio = d * _hypergeometric_log_ratio(low, n1[rows][:, None], n2[rows][:, None], m1[rows][:, None])
        logs = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(ratio[:, :-1], axis=1)], axis=1)
        logs = np.where(np.isnan(logs) | (at >= n), -np.inf, logs)
        out[rows] = first[rows] * np.exp(logs).sum(axis=1)
    return out


def _reach(start, step, n1, n2, m1, lo, hi) -> np.ndarray:
    """Terms of a tail after which nothing is added: the ratio only falls away from the mode."""
    end = np.where(step > 0, hi - start + 1, start - lo + 1)
    low = np.where(step > 0, start, start - 1)
    ratio = step * _hypergeometric_log_ratio(low, n1, n2, m1)
    with np.errstate(divide="ignore", invalid="ignore"):
        falling = np.where(ratio < 0, np.ceil(40.0 / -ratio) + 1, np.inf)
    total = n1 + n2
    spread = np.sqrt(n1 * (m1 / total) * (n2 / total) * ((total - m1) / np.maximum(total - 1, 1)))
    return np.maximum(np.minimum(np.minimum(end, falling), 12 * spread + 60), 0).astype(np.int64)


def fisher_tables(a, b, c, d) -> tuple[np.ndarray, np.ndarray]:
    """(two-sided, greater) p-values of many 2x2 tables at once.

    The tails of all tables are padded ranges of log ratios, summed row by row; the far side of
    the two-sided test is found for all of them by one bisection.  Nothing loops over tables.
    """
    a, b, c, d = (np.asarray(x, float) for x in (a, b, c, d))
    n1, n2, m1 = a + b, c + d, a + c
    lo, hi = np.maximum(0.0, m1 - n2), np.minimum(n1, m1)
    two, greater = np.ones(len(a)), np.ones(len(a))
    some = np.flatnonzero(lo < hi)
    if not len(some):
        return two, greater
    a, n1, n2, m1, lo, hi = (x[some] for x in (a, n1, n2, m1, lo, hi))
    base = _log_choose(n1 + n2, m1)

    def logp(x):
        return _log_choose(n1, x) + _log_choose(n2, m1 - x) - base

    def tail(start, step):
        inside = (start >= lo) & (start <= hi)
        at = np.clip(start, lo, hi)
        length = np.where(inside, _reach(at, step, n1, n2, m1, lo, hi), 0)
        return _tails(at, step, np.exp(logp(at)), n1, n2, m1, length)

    up, down = np.ones(len(a)), -np.ones(len(a))
    mode = np.clip(np.floor((n1 + 1) * (m1 + 1) / (n1 + n2 + 2)), lo, hi)
    above = a > mode
    side = tail(np.where(above, a, a - 1), np.where(above, up, down))
    greater[some] = np.clip(np.where(above, side, 1.0 - side), 0.0, 1.0)
    limit = logp(a) + math.log1p(1e-7)
    # The far side starts where the mass falls to that of the observed table again.
    below = a < mode
    near, far = mode.copy(), np.where(below, hi + 1, lo - 1)
    while np.any(np.abs(far - near) > 1):
        mid = np.trunc((near + far) / 2)
        mid = np.where(np.abs(far - near) > 1, mid, near)
        inside = logp(np.clip(mid, lo, hi)) <= limit
        far, near = np.where(inside & (mid != near), mid, far), np.where(inside, near, mid)
    own = tail(a, np.where(below, down, up))
    other = tail(far, np.where(below, up, down))
    two[some] = np.where(logp(mode) <= limit, 1.0, np.minimum(own + other, 1.0))
    return two, greater


def fisher_one(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(two-sided, greater) p-values of one 2x2 table."""
    two, greater = fisher_tables([a], [b], [c], [d])
    return float(two[0]), float(greater[0])


def _binomial_wide(n: float, odds: float, u: float, lo: int, mode: int, hi: int) -> int:
    """The quantile of one binomial with a very wide range, in chunks from the lower end, in two passes."""
    chunk, log_odds = _WIDEST, math.log(odds)

    def weights():
        # Logs relative to the mode, reached from the lower end by the summed ratios.
        carry = 0.0
        for x in range(lo, hi + 1, chunk):
            k = np.arange(x, min(x + chunk, hi + 1), dtype=float)
            ratio = np.log((n - k) / (k + 1)) + log_odds
            logs = carry + np.r_[0.0, np.cumsum(ratio[:-1])]
            carry = logs[-1] + ratio[-1]
            yield x, logs

    top = max(float(logs.max()) for _, logs in weights())
    total = sum(float(np.exp(logs - top).sum()) for _, logs in weights())
    done = 0.0
    for x, logs in weights():
        part = np.cumsum(np.exp(logs - top))
        if done + part[-1] >= u * total:
            return x + int(np.searchsorted(done + part, u * total))
        done += part[-1]
    return hi


def binomial_quantile(n, left, right, u) -> np.ndarray:
    """Smallest k with P(X <= k) >= u for X ~ Binomial(n, left / (left + right)), elementwise.

    Weights follow the ratio of neighbours over 8.5 standard deviations around the mode (beyond,
    less than 2^-48 is left) and are divided by their own sum, so nothing is lost for large n.  A
    row's result does not depend on the rows beside it.
    """
    n, left, right, u = (np.asarray(x, float) for x in (n, left, right, u))
    out = np.where(right <= 0, n, 0.0)
    some = np.flatnonzero((n > 0) & (left > 0) & (right > 0))
    if not len(some):
        return out.astype(np.int64)
    n, left, right, u = n[some], left[some], right[some], u[some]
    p = left / (left + right)
    mode = np.minimum(np.floor((n + 1) * p), n)
    half = np.ceil(8.5 * np.sqrt(n * p * (right / (left + right)))) + 40
    lo, hi = np.maximum(mode - half, 0), np.minimum(mode + half, n)
    width = (hi - lo + 1).astype(np.int64)
    found = np.zeros(len(some))
    odds = left / right
    for i in np.flatnonzero(width > _WIDEST):
        found[i] = _binomial_wide(n[i], odds[i], u[i], int(lo[i]), int(mode[i]), int(hi[i]))
    small = np.flatnonzero(width <= _WIDEST)
    for part, columns in _by_width(width[small]):
        rows = small[part]
        k = lo[rows][:, None] + np.arange(columns)
        inside = k <= hi[rows][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log((n[rows][:, None] - k) / (k + 1) * odds[rows][:, None])
        ratio = np.where(inside & np.isfinite(ratio), ratio, 0.0)
        logs = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(ratio[:, :-1], axis=1)], axis=1)
        logs = np.where(inside, logs, -np.inf)
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        reached = np.cumsum(weight, axis=1)
        last = reached[np.arange(len(rows)), width[rows] - 1]
        found[rows] = np.minimum(lo[rows] + (reached < (u[rows] * last)[:, None]).sum(axis=1), hi[rows])
    out[some] = found
    return out.astype(np.int64)


def ipf_g2(cells: np.ndarray, rounds: int = 500, tol: float = 1e-8) -> np.ndarray:
    """G-squared of the no-three-way-interaction model for tables of shape (n, 2, 2, C).

    A table whose fit still moves by ``tol`` of its total or more after ``rounds`` rounds gives NaN.
    """
    obs = cells.astype(float)
    fit = np.ones_like(obs)
    moved = np.zeros(len(obs))
    total = np.maximum(obs.sum(axis=(1, 2, 3)), 1.0)
    margins = [obs.sum(axis=ax, keepdims=True) for ax in (3, 2, 1)]
    for _ in range(rounds):
        before = fit
        for ax, margin in zip((3, 2, 1), margins):
            now = fit.sum(axis=ax, keepdims=True)
            fit = fit * np.divide(margin, now, out=np.zeros_like(now), where=now > 0)
        moved = np.abs(fit - before).max(axis=(1, 2, 3), initial=0.0) / total
        if np.max(moved, initial=0.0) < tol:
            break
    use = (obs > 0) & (fit > 0)
    ratio = np.divide(obs, fit, out=np.ones_like(obs), where=use)
    g2 = 2 * np.where(use, obs * np.log(ratio), 0.0).sum(axis=(1, 2, 3))
    return np.where(moved < tol, g2, np.nan)


# --- column functions ---------------------------------------------------------------


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution."""

    @F.pandas_udf("double")
    def tail(stat: pd.Series, k: pd.Series) -> pd.Series:
        p = chi2_sf_array(stat.to_numpy(float), k.to_numpy(float))
        return pd.Series(p).where(~np.isnan(p), None)

    return tail(x.cast("double"), dof.cast("double"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal deviate."""

    @F.pandas_udf("double")
    def tails(v: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(v.to_numpy(float)) / math.sqrt(2)))

    return tails(z.cast("double"))


def poisson_limits(n: Column, level: float = 0.95) -> Column:
    """Exact limits of a Poisson mean as struct(low, high); low is 0 for n = 0."""
    tail = (1 - level) / 2

    @F.pandas_udf("struct<low: double, high: double>")
    def limits(counts: pd.Series) -> pd.DataFrame:
        k = counts.to_numpy(float)
        return pd.DataFrame(
            {"low": gamma_quantile(tail, k), "high": gamma_quantile(1 - tail, k + 1)}
        )

    return limits(n.cast("double"))


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(two_sided, greater) of Fisher's exact test per row."""

    @F.pandas_udf("struct<two_sided: double, greater: double>")
    def test(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        two, greater = fisher_tables(w.to_numpy(), x.to_numpy(), y.to_numpy(), z.to_numpy())
        return pd.DataFrame({"two_sided": two, "greater": greater})

    return test(*[v.cast("bigint") for v in (a, b, c, d)])


def three_way_g2(*cells: Column) -> Column:
    """G-squared from four equally long count arrays (group x level), one table per row; NULL without a fit."""

    @F.pandas_udf("double")
    def fit(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        tables = np.stack([np.stack(s.to_numpy()) for s in (a, b, c, d)], axis=1)
        g2 = pd.Series(ipf_g2(tables.reshape(len(tables), 2, 2, -1)), dtype=object)
        return g2.where(g2.notna(), None)

    return fit(*cells)
