"""Linear models on any number of numeric and one-hot predictors.

A row of the design is z = [1, x1 .. xp, y]; everything the linear family needs
is the sum of w * z z' over rows, per group of rows (a fold, the test part) or
per bootstrap replicate (w Poisson).  Tasks accumulate these small matrices for
all groups or replicates of their rows at once (one matrix product a batch) and
hand them on as rows (g, i, j, value); Spark adds them up.  A matrix per group
is then solved where it lands, in parallel, after a rank check.

Numeric predictors and the target are shifted by their means before products
are taken, so the sums do not cancel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import MIX_K1, MIX_K2, MIX_P, hash_u32, poisson1_cdf
from lodestar.operators.linear import (Moments, alpha_grid, coordinate_descent, merge_all, original_units, pop_sd,
                                       solve)

MAX_PREDICTORS = 200     # one-hot columns included: the matrices are dense
CELLS = 10_000           # combinations of categories read to name the columns
CHUNK = 1 << 21          # numbers in a block of products
RANK = 1e-10             # smallest eigenvalue of the predictors' correlations that counts as full rank
MOMENTS = "g bigint, i int, j int, value double"


@dataclass(frozen=True)
class Design:
    numeric: tuple[str, ...]
    levels: tuple[tuple[str, str], ...]        # (column, category), the first category of each column left out
    y: str
    shift: tuple[float, ...]                   # of the numeric columns and y

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}".replace(" ", "_").replace("-", "_") for c, v in self.levels]]

    @property
    def centre(self) -> np.ndarray:
        """Shift of each of x1 .. xp, y."""
        return np.array([*self.shift[:-1], *[0.0] * len(self.levels), self.shift[-1]])

    def predictors(self) -> list[Column]:
        """x1 .. xp as they are."""
        return [F.col(c).cast("double") for c in self.numeric] + [(F.col(c) == F.lit(v)).cast("double") for c, v in self.levels]

    def row(self) -> Column:
        x = [(e - F.lit(s)) if s else e for e, s in zip([*self.predictors(), F.col(self.y).cast("double")], self.centre.tolist())]
        return F.array(F.lit(1.0), *x)

    def complete(self, df: DataFrame) -> DataFrame:
        return df.na.drop("any", subset=[*self.numeric, *{c for c, _ in self.levels}, self.y])


def fit_design(df: DataFrame, numeric: list[str], one_hot: list[str], y: str) -> Design:
    """One pass: means, and the categories from the counts of their combinations."""
    used = [*numeric, y]
    cells = df.na.drop("any", subset=[*used, *one_hot]).groupBy(*one_hot).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).cast("double")).alias(f"__s_{c}") for c in used])
    rows = cells.limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        raise ValueError(f"more than {CELLS} combinations of {one_hot}: encode them as labels instead")
    n = sum(r["__n"] for r in rows)
    shift = tuple(sum(r[f"__s_{c}"] or 0.0 for r in rows) / n if n else 0.0 for c in used)
    levels = tuple((c, v) for c in one_hot for v in sorted({r[c] for r in rows})[1:])
    if len(numeric) + len(levels) > MAX_PREDICTORS:
        raise ValueError(f"{len(numeric) + len(levels)} predictors; at most {MAX_PREDICTORS} make a dense system")
    return Design(tuple(numeric), levels, y, shift)


def poisson_weights(h: np.ndarray, reps: int) -> np.ndarray:
    """The replicate weights of :mod:`lodestar.functions.hashing`, rows by replicates."""
    h = h.astype(np.int64)[:, None]
    x = (h + (np.arange(reps, dtype=np.int64) + 1) * MIX_K1) % MIX_P
    u = ((x * x % MIX_P) * MIX_K2 + h) % MIX_P / float(MIX_P)
    return np.searchsorted(poisson1_cdf(), u, side="right").astype(np.float64)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _long(groups, values: np.ndarray, width: int) -> pa.RecordBatch:
    """Upper triangles (one row per group) as rows (g, i, j, value)."""
    i, j = np.triu_indices(width)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.asarray(groups, np.int64), len(i))), pa.array(np.tile(i, len(values)).astype(np.int32)),
         pa.array(np.tile(j, len(values)).astype(np.int32)), pa.array(values.ravel())], names=["g", "i", "j", "value"])


def _cross_products(width: int):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        pick = np.triu_indices(width)
        for batch in batches:
            g, z = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k in np.unique(g):
                part = z[g == k]
                sums[int(k)] = sums.get(int(k), 0.0) + (part.T @ part)[pick]
            if len(sums) > 1000:
                yield _long(list(sums), np.array(list(sums.values())), width)
                sums = {}
        if sums:
            yield _long(list(sums), np.array(list(sums.values())), width)
    return run


def _replicate_products(width: int, reps: int):
    def run(batches):
        i, j = np.triu_indices(width)
        total, step = np.zeros((reps, len(i))), max(1, CHUNK // max(reps, len(i)))
        for batch in batches:
            h, z = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for lo in range(0, len(h), step):
                part = z[lo:lo + step]
                total += poisson_weights(h[lo:lo + step], reps).T @ (part[:, i] * part[:, j])
        yield _long(range(reps), total, width)
    return run


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("g", "i", "j").agg(F.sum("value").alias("value"))


def cross_moments(df: DataFrame, design: Design, group: Column) -> DataFrame:
    """(g, i, j, value): sums of z_i z_j over the complete rows of each group, i <= j."""
    rows = design.complete(df).select(group.cast("bigint").alias("g"), design.row().alias("z"))
    return _added(rows.mapInArrow(_cross_products(len(design.names) + 2), MOMENTS))


def replicate_moments(df: DataFrame, design: Design, key: str, reps: int) -> DataFrame:
    """(g, i, j, value) for each Poisson-bootstrap replicate g."""
    rows = design.complete(df).select(hash_u32(key, "boot").alias("h"), design.row().alias("z"))
    return _added(rows.mapInArrow(_replicate_products(len(design.names) + 2, reps), MOMENTS))


def to_matrix(i, j, value) -> np.ndarray:
    width = int(max(j)) + 1
    m = np.zeros((width, width))
    m[i, j] = value
    m[j, i] = value
    return m


def to_moments(m: np.ndarray, design: Design) -> Moments:
    """Count, means and centred co-moments of a group's matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return Moments(n, mean + design.centre, m[1:, 1:] - n * np.outer(mean, mean))


def collect_moments(moments: DataFrame, design: Design) -> dict[int, Moments]:
    """The matrices of a handful of groups on the driver."""
    out = {}
    for g, part in moments.toPandas().groupby("g"):
        out[int(g)] = to_moments(to_matrix(part["i"].to_numpy(), part["j"].to_numpy(), part["value"].to_numpy()), design)
    return out


def least_squares(m: Moments, min_norm: bool = False) -> tuple[float, np.ndarray] | None:
    """(b0, beta); None where the predictors are not of full rank, or the
    smallest solution on their common scale if asked for."""
    c, cy = m.C[:-1, :-1] / m.n, m.C[:-1, -1] / m.n
    sd = np.sqrt(np.maximum(np.diag(c), 0.0))
    scale = np.where(sd > 0, sd, 1.0)
    r = c / np.outer(scale, scale)
    full = len(sd) == 0 or ((sd > 0).all() and np.linalg.eigvalsh(r)[0] > RANK)
    if not full and not min_norm:
        return None
    beta = (np.linalg.solve(r, cy / scale) if full else np.linalg.pinv(r, rcond=RANK, hermitian=True) @ (cy / scale)) / scale
    return float(m.mean[-1] - beta @ m.mean[:-1]), beta


SOLVED = "g bigint, term string, coef double, std_coef double"


def solve_each(moments: DataFrame, design: Design, min_norm: bool = False) -> DataFrame:
    """(g, term, coef, std_coef) of ordinary least squares per group: the
    coefficient, and the one of predictors scaled to unit (population) sd.
    Null where a group has no rows or its predictors are not of full rank."""
    terms = ["intercept", *design.names]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = to_matrix(part["i"].to_numpy(), part["j"].to_numpy(), part["value"].to_numpy())
        got, std = None, np.full(len(terms), np.nan)
        if m[0, 0] > 0:
            full = to_moments(m, design)
            got = least_squares(full, min_norm)
        coef = np.full(len(terms), np.nan) if got is None else np.array([got[0], *got[1]])
        if got is not None:
            std = np.array([full.mean[-1], *(got[1] * np.sqrt(np.maximum(np.diag(full.C)[:-1], 0.0) / full.n))])
        out = pd.DataFrame({"g": part["g"].iloc[0], "term": terms, "coef": coef, "std_coef": std})
        return out.astype({"coef": object, "std_coef": object}).where(~out.isna(), None)
    return moments.groupBy("g").applyInPandas(run, SOLVED)


def coefficient_intervals(df: DataFrame, design: Design, key: str, reps: int, alpha: float = 0.05) -> DataFrame:
    """(term, value, ci_lower, ci_upper, significant): the fit and percentile
    intervals over Poisson replicates.  A replicate that cannot be fitted keeps
    the original coefficients."""
    full = solve_each(cross_moments(df, design, F.lit(0)), design, min_norm=True).select("term", F.col("coef").alias("value"))
    each = solve_each(replicate_moments(df, design, key, reps), design).select("term", "coef")
    held = each.join(F.broadcast(full), "term").withColumn("coef", F.coalesce("coef", "value"))      # one row per term
    out = held.groupBy("term").agg(F.first("value").alias("value"), F.percentile("coef", alpha / 2).alias("ci_lower"),
                                   F.percentile("coef", 1 - alpha / 2).alias("ci_upper"))
    return out.withColumn("significant", ~((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)))


# Names of the linear models in the reports.
FAMILY = ["Lineal Simple (Test)", "Lineal Múltiple (Test)", "Ridge Regression", "Lasso Regression", "Elastic Net"]
SCORES = "rep bigint, model int, sw double, sy double, syy double, se double, sa double"


def _scores(reps: int, models: int):
    def run(batches):
        total = np.zeros((reps + 1, 3 + 2 * models))
        step = max(1, CHUNK // reps)
        for batch in batches:
            h, y, pred = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            e = y[:, None] - pred
            x = np.column_stack([np.ones(len(y)), y, y * y, e * e, np.abs(e)])
            total[0] += x.sum(axis=0)
            for lo in range(0, len(h), step):
                total[1:] += poisson_weights(h[lo:lo + step], reps).T @ x[lo:lo + step]
        rep = np.repeat(np.arange(-1, reps), models)
        model = np.tile(np.arange(models), reps + 1)
        cols = [np.repeat(total[:, k], models) for k in range(3)] + [total[:, 3:3 + models].ravel(), total[:, 3 + models:].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(model.astype(np.int32)), *[pa.array(c) for c in cols]],
                                         names=[x.split()[0] for x in SCORES.split(", ")])
    return run


def score_models(df: DataFrame, design: Design, models: dict[str, tuple[float, np.ndarray]], key: str, reps: int,
                 alpha: float = 0.05) -> DataFrame:
    """One row per model: R2, RMSE and MAE on the complete rows of ``df`` with
    percentile intervals over Poisson replicates; all models and replicates from
    one pass."""
    x = design.predictors()
    shift = F.lit(float(design.shift[-1]))

    def predicted(b0, beta):
        e = F.lit(float(b0))
        for b, c in zip(beta, x):
            e = e + F.lit(float(b)) * c if b else e
        return e - shift
    rows = design.complete(df).select(hash_u32(key, "boot").alias("h"), (F.col(design.y).cast("double") - shift).alias("y"),
                                      F.array(*[predicted(*m) for m in models.values()]).alias("pred"))
    sums = [x.split()[0] for x in SCORES.split(", ")][2:]
    per = rows.mapInArrow(_scores(reps, len(models)), SCORES).groupBy("rep", "model").agg(*[F.sum(c).alias(c) for c in sums])
    per = per.select("rep", "model", F.sqrt(F.try_divide("se", "sw")).alias("rmse"), F.try_divide("sa", "sw").alias("mae"),
                     (F.lit(1.0) - F.try_divide(F.col("se"), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("sw")))).alias("r2"))
    aggs = []
    for c in ("r2", "rmse", "mae"):
        own = F.when(F.col("rep") >= 0, F.col(c))
        aggs += [F.max(F.when(F.col("rep") < 0, F.col(c))).alias(c), F.percentile(own, alpha / 2).alias(f"{c}_ci_lower"),
                 F.percentile(own, 1 - alpha / 2).alias(f"{c}_ci_upper")]
    out = per.groupBy("model").agg(*aggs)
    name = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("model") + 1)
    return out.select(name.alias("modelo"), *[c for c in out.columns if c != "model"])


def linear_family(folds: dict[int, Moments], alphas: list[float], enet: tuple[float, float], simple: int = 0) -> dict[str, tuple[float, np.ndarray]]:
    """The five linear models from the moments of the training folds, in raw
    units: one predictor, all of them, and ridge, lasso (each with the alpha of
    the best mean held-out R2) and elastic net on standardised predictors."""
    whole = merge_all([folds[k] for k in sorted(folds)])
    mu, sd = whole.mean[:-1], pop_sd(whole)
    scaled = whole.standardise(mu, sd)
    one = whole.C[simple, -1] / whole.C[simple, simple]
    alone = np.zeros(len(mu))
    alone[simple] = one

    def best(fit):
        return max(alpha_grid(folds, alphas, whole, fit), key=lambda r: (r[1], -r[0]))[0]
    ridge, lasso = best(solve), best(coordinate_descent)
    fits = [(float(whole.mean[-1] - one * mu[simple]), alone), least_squares(whole, min_norm=True),
            original_units(*solve(scaled, ridge), mu, sd), original_units(*coordinate_descent(scaled, lasso), mu, sd),
            original_units(*coordinate_descent(scaled, *enet), mu, sd)]
    return dict(zip(FAMILY, fits, strict=True))
