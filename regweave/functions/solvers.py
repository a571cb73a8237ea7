"""Small per-target solves from sums of squares and products.

Every function takes a :class:`System` (centred sums of one target) and returns
``(coefficients, fit)``: a frame indexed like the terms and a dict of
goodness-of-fit values. Sizes are terms x terms; cells never appear here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from regweave.functions.tails import normal_two_sided, student_two_sided

_ALIAS_TOL = 1e-10


@dataclass
class System:
    n: float
    mean_x: np.ndarray
    mean_y: float
    xx: np.ndarray      # centred X'X
    xy: np.ndarray      # centred X'y
    yy: float           # centred y'y
    raw: np.ndarray     # uncentred sums of squares of the terms
    labels: np.ndarray

    @classmethod
    def from_rows(cls, i, j, s, n: float, p: int | None = None) -> "System":
        i, j, s = np.asarray(i, int), np.asarray(j, int), np.asarray(s, float)
        p = int(max(j.max(initial=0), 0)) if p is None else p
        g = np.zeros((p + 2, p + 2))            # 0: response, 1: intercept, 2..: terms
        g[i + 1, j + 1] = s
        g[j + 1, i + 1] = s
        return cls.from_dense(g, n)

    @classmethod
    def from_dense(cls, g: np.ndarray, n: float) -> "System":
        sx, sy = g[1, 2:], g[1, 0]
        mx, my = sx / n, sy / n
        return cls(n, mx, my, g[2:, 2:] - np.outer(sx, mx), g[2:, 0] - sx * my,
                   max(g[0, 0] - sy * my, 0.0), np.diag(g)[2:].copy(),
                   np.arange(1, g.shape[0] - 1))

    def intercept(self, beta: np.ndarray) -> float:
        return float(self.mean_y - self.mean_x @ beta)

    def rsq(self, beta: np.ndarray) -> float:
        rss = self.yy - 2 * beta @ self.xy + beta @ self.xx @ beta
        return float(1 - rss / self.yy) if self.yy > 0 else np.nan


def independent_columns(a: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Columns kept when later linear combinations of earlier ones are dropped."""
    p = a.shape[0]
    chol, keep = np.zeros((p, 0)), []
    for k in range(p):
        resid = a[k, k] - chol[k] @ chol[k]
        if resid <= _ALIAS_TOL * max(scale[k], a[k, k]) or resid <= 0:
            continue
        col = (a[:, k] - chol @ chol[k]) / np.sqrt(resid)
        col[:k] = 0.0
        chol = np.column_stack([chol, col])
        keep.append(k)
    return np.asarray(keep, dtype=int)


def _frame(labels, **cols) -> pd.DataFrame:
    return pd.DataFrame({"j": np.asarray(labels, dtype="int32"), **cols})


def ols(sys: System):
    """Least squares with intercept; aliased terms are absent from the result."""
    keep = independent_columns(sys.xx, sys.raw)
    a, b, mx = sys.xx[np.ix_(keep, keep)], sys.xy[keep], sys.mean_x[keep]
    inv = np.linalg.inv(a) if len(keep) else np.zeros((0, 0))
    beta = inv @ b
    rss = max(sys.yy - float(beta @ b), 0.0)
    df = sys.n - len(keep) - 1
    s2 = rss / df if df > 0 else np.nan
    est = np.r_[sys.mean_y - mx @ beta, beta]
    var = np.r_[1 / sys.n + mx @ inv @ mx, np.diag(inv)] * s2
    se = np.sqrt(np.maximum(var, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = est / se
    coefs = _frame(np.r_[0, sys.labels[keep]], estimate=est, std_err=se, statistic=t,
                   pval=student_two_sided(t, df))
    return coefs, {"rsq": 1 - rss / sys.yy if sys.yy > 0 else np.nan}


def _coordinate_descent(c, q, lambdas, alpha, tol=1e-7, max_iter=100_000):
    """Elastic-net path for correlation matrix ``c`` and correlations ``q`` with y."""
    p = len(q)
    beta, grad, path = np.zeros(p), q.copy(), []
    for lam in lambdas:
        l1, den = lam * alpha, 1.0 + lam * (1 - alpha)
        sweep = np.arange(p)
        for _ in range(max_iter):
            delta = 0.0
            for k in sweep:
                z = grad[k] + beta[k]
                new = np.sign(z) * max(abs(z) - l1, 0.0) / den
                d = new - beta[k]
                if d != 0.0:
                    beta[k] = new
                    grad -= c[:, k] * d
                    delta = max(delta, d * d)
            if delta < tol:
                if len(sweep) == p:
                    break
                sweep = np.arange(p)
            else:
                sweep = np.flatnonzero(beta) if len(sweep) == p else sweep
                if len(sweep) == 0:
                    sweep = np.arange(p)
        path.append(beta.copy())
    return np.array(path)


def _standardised(sys: System):
    sd = np.sqrt(np.maximum(np.diag(sys.xx), 0.0) / sys.n)
    ok = np.flatnonzero(sd > 0)
    sy = np.sqrt(sys.yy / sys.n)
    s = sd[ok]
    c = sys.xx[np.ix_(ok, ok)] / np.outer(s, s) / sys.n
    q = sys.xy[ok] / (s * sy) / sys.n if sy > 0 else np.zeros(len(ok))
    return ok, s, sy, c, q


def lambda_path(q: np.ndarray, n: float, p: int, alpha: float, n_lambda: int = 100):
    top = np.max(np.abs(q), initial=0.0) / max(alpha, 1e-3)
    ratio = 1e-4 if n > p else 1e-2
    return top * ratio ** (np.arange(n_lambda) / (n_lambda - 1))


def _enet_path(sys: System, alpha: float, n_lambda: int):
    """Path with the usual early stop once the explained deviance levels off."""
    ok, s, sy, c, q = _standardised(sys)
    lambdas = lambda_path(q, sys.n, len(sys.xy), alpha, n_lambda)
    betas = _coordinate_descent(c, q, lambdas, alpha)
    dev = 2 * betas @ q - np.einsum("lp,pk,lk->l", betas, c, betas)
    stop = len(dev)
    for k in range(5, len(dev)):
        if dev[k] - dev[k - 1] < 1e-5 * dev[k] or dev[k] > 0.999:
            stop = k + 1
            break
    full = np.zeros((stop, len(sys.xy)))
    full[:, ok] = betas[:stop] * sy / s
    return lambdas[:stop], full, dev[:stop], sy


def elastic_net(sys: System, alpha: float = 0.5, n_lambda: int = 100):
    """Sparsest model of the path that reaches 95 % of the best explained deviance."""
    if sys.yy <= 0:
        raise ValueError("constant response")
    lambdas, betas, dev, sy = _enet_path(sys, alpha, n_lambda)
    k = int(np.flatnonzero(dev > 0.95 * dev.max())[0]) if dev.max() > 0 else 0
    beta = betas[k]
    coefs = _frame(np.r_[0, sys.labels], estimate=np.r_[sys.intercept(beta), beta])
    return coefs, {"rsq": float(dev[k]), "lambda": float(lambdas[k] * sy), "alpha": alpha}


def cv_elastic_net(total: np.ndarray, folds: list[np.ndarray], sizes: list[float],
                   alpha: float = 0.5, n_lambda: int = 100):
    """Cross-validated choice (one standard error rule); all from Gram matrices."""
    n = float(sum(sizes))
    sys = System.from_dense(total, n)
    if sys.yy <= 0:
        raise ValueError("constant response")
    lambdas, betas, dev, sy = _enet_path(sys, alpha, n_lambda)
    mse, wts = [], []
    for g, m in zip(folds, sizes):
        if m <= 0:
            continue
        train = System.from_dense(total - g, n - m)
        ok, s, tsy, c, q = _standardised(train)
        if tsy <= 0:
            continue
        b = np.zeros((len(lambdas), len(sys.xy)))
        # Penalties are compared on the response scale of the full fit.
        b[:, ok] = _coordinate_descent(c, q, lambdas * sy / tsy, alpha) * tsy / s
        b0 = train.mean_y - b @ train.mean_x
        theta = np.column_stack([-np.ones(len(b)), b0, b])
        held = g.copy()
        held[1, 1] = m
        mse.append(np.einsum("lp,pk,lk->l", theta, held, theta) / m)
        wts.append(m)
    mse, wts = np.array(mse), np.array(wts) / np.sum(wts)
    cvm = wts @ mse
    cvsd = np.sqrt(wts @ (mse - cvm) ** 2 / max(len(wts) - 1, 1))
    best = int(np.argmin(cvm))
    k = int(np.flatnonzero(cvm <= cvm[best] + cvsd[best])[0])
    coefs = _frame(np.r_[0, sys.labels], estimate=np.r_[sys.intercept(betas[k]), betas[k]])
    return coefs, {"rsq": float(dev[k]), "lambda": float(lambdas[k] * sy), "alpha": alpha}


def ridge(sys: System, alpha: float, columns: np.ndarray) -> np.ndarray:
    a = sys.xx[np.ix_(columns, columns)] + alpha * np.eye(len(columns))
    return np.linalg.solve(a, sys.xy[columns])


def bayesian_ridge(sys: System, max_iter: int = 300, tol: float = 1e-3, prior: float = 1e-6):
    """Evidence maximisation for a shared weight precision and a noise precision."""
    if len(sys.xy) < 2:
        raise ValueError("needs at least two terms")
    ev, vec = np.linalg.eigh(sys.xx)
    ev = np.maximum(ev, 0.0)
    noise = 1.0 / (sys.yy / sys.n + np.finfo(float).eps)
    weight, last = 1.0, None
    proj = vec.T @ sys.xy
    for _ in range(max_iter):
        beta = vec @ (proj / (ev + weight / noise))
        rss = sys.yy - 2 * beta @ sys.xy + beta @ sys.xx @ beta
        gamma = np.sum(noise * ev / (weight + noise * ev))
        weight = (gamma + 2 * prior) / (beta @ beta + 2 * prior)
        noise = (sys.n - gamma + 2 * prior) / (rss + 2 * prior)
        if last is not None and np.sum(np.abs(last - beta)) < tol:
            break
        last = beta
    beta = vec @ (proj / (ev + weight / noise))
    var = np.einsum("ij,j,ij->i", vec, 1.0 / (ev + weight / noise), vec) / noise
    p = normal_two_sided(beta / np.sqrt(var))
    with np.errstate(divide="ignore"):
        coefs = _frame(sys.labels, estimate=beta, est_variance=var, pval=p,
                       neglog10p=-np.log10(np.where(np.isnan(p), 1.0, p)))
    return coefs, {"rsq": sys.rsq(beta)}


def bayes_linear(sys: System, prior_sd: float = 1.0, max_iter: int = 200):
    """Gaussian posterior under N(0, prior_sd) coefficients, noise by EM."""
    p = len(sys.xy)
    prec = np.eye(p) / prior_sd**2
    s2 = max(sys.yy / sys.n, 1e-12)
    for _ in range(max_iter):
        cov = np.linalg.inv(sys.xx / s2 + prec)
        m = cov @ sys.xy / s2
        rss = sys.yy - 2 * m @ sys.xy + m @ sys.xx @ m + np.trace(sys.xx @ cov)
        new = max(rss / sys.n, 1e-12)
        if abs(new - s2) <= 1e-10 * s2:
            s2 = new
            break
        s2 = new
    var_b = np.r_[s2 / sys.n + sys.mean_x @ cov @ sys.mean_x, np.diag(cov)]
    est, sd = np.r_[sys.intercept(m), m], np.sqrt(var_b)
    z95 = 1.6448536269514722      # 95 % point of the standard normal
    coefs = _frame(np.r_[0, sys.labels], estimate=est, est_error=sd, q5=est - z95 * sd,
                   q95=est + z95 * sd, pval=np.exp(-0.5 * (est / sd) ** 2))
    fit = (m @ sys.xx @ m + np.trace(sys.xx @ cov)) / max(sys.n - 1, 1)
    return coefs, {"rsq": float(fit / (fit + s2))}
