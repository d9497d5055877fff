"""Distribution helpers.

Two kinds: scalar functions evaluated once on the driver (a t quantile for a
known small df), and Column expressions evaluated per row inside whole-stage
codegen (normal pdf, inverse normal, a t quantile whose df is data-dependent).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054  # Phi^-1(0.975)


# ----------------------------------------------------------------- driver side
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return 1.0 - tail if t >= 0 else tail


def t_ppf(p: float, df: float) -> float:
    """Student-t quantile by bisection on the CDF (one scalar, driver side)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


# ------------------------------------------------------------- per-row columns
def t975_expr(df: Column) -> Column:
    """Two-sided 95 % t quantile for a data-dependent df (Cornish-Fisher).

    Four-term expansion around z; error below 1e-6 for df >= 30, which is the
    regime of every residual df here (n - k - 1 with n in the thousands).
    """
    z = Z975
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    v = df.cast("double")
    return F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)


def sql_t975(df_sql: str) -> str:
    z = Z975
    g = [(z ** 3 + z) / 4.0,
         (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0,
         (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0,
         (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0]
    v = f"CAST({df_sql} AS DOUBLE)"
    return (f"({z:.17e} + {g[0]:.17e} / {v} + {g[1]:.17e} / ({v} * {v}) + "
            f"{g[2]:.17e} / ({v} * {v} * {v}) + {g[3]:.17e} / ({v} * {v} * {v} * {v}))")


def normal_pdf(x: Column, mu: Column, sd: Column) -> Column:
    return F.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


# Coefficients of Acklam's rational approximation of the inverse
# normal CDF (published, relative error 1.15e-9).
_ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
             1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
             6.680131188771972e+01, -1.328068155288572e+01]
_ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00]


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def inv_normal(p: Column) -> Column:
    """Phi^-1(p) as a codegen-friendly expression (null outside (0, 1))."""
    plow = 0.02425
    q_low = F.sqrt(-2.0 * F.log(p))
    low = _horner(_ACKLAM_C, q_low) / (_horner(_ACKLAM_D, q_low) * q_low + 1.0)
    q = p - 0.5
    r = q * q
    mid = _horner(_ACKLAM_A, r) * q / (_horner(_ACKLAM_B, r) * r + 1.0)
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    high = -_horner(_ACKLAM_C, q_hi) / (_horner(_ACKLAM_D, q_hi) * q_hi + 1.0)
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
            .when(p < plow, low).when(p > 1 - plow, high).otherwise(mid))


def _sql_horner(coefs, x: str) -> str:
    acc = f"{coefs[0]:.17e}"
    for c in coefs[1:]:
        acc = f"(({acc}) * ({x}) + {c:.17e})"
    return acc


def sql_inv_normal(p: str) -> str:
    """DuckDB twin of :func:`inv_normal` (same operations, same constants)."""
    plow = 0.02425
    ql = f"sqrt(-2.0e0 * ln({p}))"
    low = f"({_sql_horner(_ACKLAM_C, ql)} / ({_sql_horner(_ACKLAM_D, ql)} * {ql} + 1.0e0))"
    q = f"({p} - 5.0e-1)"
    r = f"({q} * {q})"
    mid = f"({_sql_horner(_ACKLAM_A, r)} * {q} / ({_sql_horner(_ACKLAM_B, r)} * {r} + 1.0e0))"
    qh = f"sqrt(-2.0e0 * ln(1.0e0 - {p}))"
    high = f"(-{_sql_horner(_ACKLAM_C, qh)} / ({_sql_horner(_ACKLAM_D, qh)} * {qh} + 1.0e0))"
    return (f"(CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {plow:.17e} THEN {low} "
            f"WHEN {p} > {1 - plow:.17e} THEN {high} ELSE {mid} END)")
