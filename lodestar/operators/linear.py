"""Linear family through sufficient statistics (survey 2K K1-K6, K14-K16).

One aggregation pass computes, per group (fold, replicate, or nothing), the
count, the means and the centred co-moment matrix of [x..., y] with Spark's
numerically stable ``covar_pop``.  Everything else -- OLS, ridge for any
alpha, fold-out training statistics (Chan's merge of the other folds),
held-out SSE and R^2, standardised coefficients -- is a (p+1)x(p+1) problem
on the driver.  Nothing row-sized ever leaves the executors; the data are
scanned once whatever the number of folds and alphas.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    n: float
    mean: np.ndarray      # length p+1, last entry is y
    C: np.ndarray         # (p+1)x(p+1) centred co-moments (n * covariance)

    def merge(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        d = o.mean - self.mean
        mean = self.mean + d * (o.n / n)
        C = self.C + o.C + np.outer(d, d) * (self.n * o.n / n)
        return Moments(n, mean, C)

    def standardise(self, mu: np.ndarray, sd: np.ndarray) -> "Moments":
        """Moments of z = (x - mu)/sd (y untouched): pure algebra, no pass."""
        scale = np.append(1.0 / sd, 1.0)
        mean = (self.mean - np.append(mu, 0.0)) * scale
        return Moments(self.n, mean, self.C * np.outer(scale, scale))


def moments(df: DataFrame, xcols: list[str], y: str, by: str | None = None) -> dict:
    """One pass: {group: Moments}; the collected result has one row per group."""
    cols = xcols + [y]
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.avg(F.col(c).cast("double")).alias(f"__m{i}")
                                               for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            aggs.append(F.covar_pop(F.col(a).cast("double"), F.col(cols[j]).cast("double")).alias(f"__c{i}_{j}"))
    base = df.na.drop(subset=cols)
    rows = (base.groupBy(by).agg(*aggs) if by else base.agg(*aggs)).collect()
    out = {}
    k = len(cols)
    for r in rows:
        n = float(r["__n"])
        mean = np.array([r[f"__m{i}"] for i in range(k)], dtype=float)
        C = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                C[i, j] = C[j, i] = (r[f"__c{i}_{j}"] or 0.0) * n
        out[r[by] if by else None] = Moments(n, mean, C)
    return out


def merge_all(parts: list[Moments]) -> Moments:
    acc = parts[0]
    for m in parts[1:]:
        acc = acc.merge(m)
    return acc


def solve(m: Moments, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """OLS (alpha 0) or ridge with an unpenalised intercept: (b0, beta)."""
    p = len(m.mean) - 1
    A = m.C[:p, :p] + alpha * np.eye(p)
    beta = np.linalg.solve(A, m.C[:p, p])
    b0 = m.mean[p] - beta @ m.mean[:p]
    return float(b0), beta


def sse(m: Moments, b0: float, beta: np.ndarray) -> float:
    """Sum of squared errors of (b0, beta) on the rows summarised by ``m``."""
    p = len(beta)
    Sxx, Sxy, Syy = m.C[:p, :p], m.C[:p, p], m.C[p, p]
    bias = m.mean[p] - b0 - beta @ m.mean[:p]
    return float(Syy - 2 * beta @ Sxy + beta @ Sxx @ beta + m.n * bias * bias)


def r2(m: Moments, b0: float, beta: np.ndarray) -> float:
    return 1.0 - sse(m, b0, beta) / m.C[-1, -1]


def pop_sd(m: Moments) -> np.ndarray:
    """Population deviations of the predictors; 1 for a constant one."""
    sd = np.sqrt(np.maximum(np.diag(m.C)[:-1] / m.n, 0.0))
    return np.where(sd > 0, sd, 1.0)


def original_units(b0: float, beta: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> tuple[float, np.ndarray]:
    """Coefficients of standardised predictors as those of the raw ones."""
    raw = beta / sd
    return float(b0 - raw @ mu), raw


def fold_out(folds: dict, f) -> Moments:
    """Training statistics of fold ``f`` = merge of every other fold."""
    return merge_all([m for g, m in sorted(folds.items()) if g != f])


def alpha_grid(folds: dict, alphas: list[float], standardise_with: Moments | None = None, fit=solve) -> list[tuple]:
    """K6: mean held-out R^2 per alpha from per-fold moments (one data pass);
    ``fit(moments, alpha)`` is ridge unless given (the lasso: ``coordinate_descent``).

    With ``standardise_with`` the features are z-scored with that set's mean
    and population sd first (the scaler is fitted once, before the folds).
    """
    if standardise_with is not None:
        mu, sd = standardise_with.mean[:-1], pop_sd(standardise_with)
        folds = {f: m.standardise(mu, sd) for f, m in folds.items()}
    out = []
    for a in alphas:
        scores = []
        for f in sorted(folds):
            b0, beta = fit(fold_out(folds, f), a)
            scores.append(r2(folds[f], b0, beta))
        out.append((float(a), float(np.mean(scores)), [float(s) for s in scores]))
    return out


def predict_expr(b0: float, beta: np.ndarray, xcols: list[str]):
    """Linear predictor as a Catalyst expression with literal coefficients."""
    e = F.lit(float(b0))
    for b, c in zip(beta, xcols):
        e = e + F.lit(float(b)) * F.col(c).cast("double")
    return e


def coordinate_descent(m: Moments, alpha: float, l1_ratio: float = 1.0, max_iter: int = 2000,
                       tol: float = 1e-10) -> tuple[float, np.ndarray]:
    """Elastic net / lasso on the Gram (covariance updates).

    Minimises 1/(2n)|y - b0 - Xb|^2 + alpha*l1*|b|_1 + alpha*(1-l1)/2*|b|^2,
    the same objective as the reference's estimators, using only the
    (p+1)x(p+1) co-moments of one data pass.
    """
    p = len(m.mean) - 1
    G = m.C[:p, :p] / m.n
    c = m.C[:p, p] / m.n
    b = np.zeros(p)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            rho = c[j] - G[j] @ b + G[j, j] * b[j]
            if G[j, j] + l2 <= 0.0:                   # a constant predictor stays out
                continue
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (G[j, j] + l2)
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta < tol:
            break
    b0 = m.mean[p] - b @ m.mean[:p]
    return float(b0), b
