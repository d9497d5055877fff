"""Properties of splitting, resampling, scaling and fitting (partition
independence, coverage, inverses, agreement with Spark ML)."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodestar.operators import inference as inf
from lodestar.operators import linear as lin
from lodestar.operators import ordering as od
from lodestar.operators import resample as rs
from lodestar.operators.transform import NotFittedError, Scaler
from lodestar.plans.facts import facts
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return facts(spark, SF_SMALL).cache()


def test_split_covers_all_rows_and_is_partition_independent(fx):
    train, test = rs.train_test(fx, "id")
    assert train.count() + test.count() == fx.count()
    assert train.join(test, "id").count() == 0
    a = {r.id for r in test.collect()}
    b = {r.id for r in rs.train_test(fx.repartition(7), "id")[1].collect()}
    assert a == b
    share = len(a) / fx.count()
    assert 0.1 < share < 0.3


def test_contiguous_folds_sizes_and_order(fx):
    f = rs.with_folds(fx.select("id"), "id", 5, contiguous=True)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 1
    rows = sorted((r.id, r.fold) for r in f.collect())
    folds = [x[1] for x in rows]
    assert folds == sorted(folds)                     # contiguous blocks in key order


def test_global_index_is_exact(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7 % 1003).alias("k")).repartition(5)
    idx = od.global_index(df, ["k"], idx_col="i", n_col="n").collect()
    assert all(r.i == r.k for r in idx)
    assert {r.n for r in idx} == {1003}


def test_bootstrap_interval_contains_point_and_is_partition_independent(fx):
    p = fx.select("id", F.col("total").alias("y"), (F.col("n_lines") * 30000.0).alias("pred"))
    a = inf.metrics_with_ci(p, "id", "y", "pred", 50, "m").first()
    b = inf.metrics_with_ci(p.repartition(3), "id", "y", "pred", 50, "m").first()
    assert a == b
    for m in ("rmse", "mae"):
        assert a[f"{m}_ci_lower"] <= a[m] <= a[f"{m}_ci_upper"]


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    w = rs.replicate_weights(df, "k", 2).agg(F.avg("w"), F.variance("w")).first()
    assert abs(w[0] - 1.0) < 0.03 and abs(w[1] - 1.0) < 0.05


@pytest.mark.parametrize("method", ["standard", "robust", "minmax"])
def test_scaler_inverse_is_identity(fx, method):
    cols = ["qty", "total"]
    sc = Scaler(cols, method).fit(fx)
    back = sc.inverse_transform(sc.transform(fx.select("id", *cols))).orderBy("id").collect()
    orig = fx.select("id", *cols).orderBy("id").collect()
    for a, b in zip(back, orig):
        assert a.qty == pytest.approx(b.qty, rel=1e-9) and a.total == pytest.approx(b.total, rel=1e-9)


def test_scaler_requires_fit(fx):
    with pytest.raises(NotFittedError):
        Scaler(["qty"], "standard").transform(fx)


def test_gram_ols_equals_spark_normal_solver(fx):
    d = fx.select(F.col("n_lines").cast("double").alias("n_lines"), "qty", "total")
    m = lin.moments(d, ["n_lines", "qty"], "total")[None]
    b0, beta = lin.solve(m)
    asm = VectorAssembler(inputCols=["n_lines", "qty"], outputCol="features")
    model = LinearRegression(featuresCol="features", labelCol="total", solver="normal", regParam=0.0,
                             standardization=False).fit(asm.transform(d))
    assert b0 == pytest.approx(model.intercept, rel=1e-6)
    assert np.allclose(beta, model.coefficients.toArray(), rtol=1e-6)


def test_bootstrap_interval_holds_the_point_estimate(fx):
    """Every row has its own weight; the interval lies around the estimate."""
    e = F.col("total") - F.col("n_lines") * 30000.0
    src = fx.select("id", "total", "n_lines")
    per = rs.replicate_sums(src, "id", 200, {"sw": F.lit(1.0), "se": e * e})
    got = rs.percentile_ci(per.select(F.sqrt(F.col("se") / F.col("sw")).alias("rmse")), ["rmse"]).first()
    point = src.agg(F.sqrt(F.avg(e * e))).first()[0]
    assert got.rmse_ci_lower < point < got.rmse_ci_upper


def test_exact_quantiles_with_a_hot_value(spark):
    """A third of the rows share one value: the result must equal numpy's
    linear-interpolation percentiles, per group and overall."""
    from lodestar.operators import profile as pf
    vals = [5.0] * 1000 + [float(i % 97) for i in range(2000)]
    rows = [(i, "a" if i % 2 else "b", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(6)
    probs = [0.1, 0.25, 0.5, 0.9]
    got = {(r.g, r.p_index): r.q for r in pf.quantiles(df, "v", probs, by=["g"]).collect()}
    for g in ("a", "b"):
        xs = np.array([v for i, gg, v in rows if gg == g])
        for k, p in enumerate(probs):
            assert got[(g, k)] == pytest.approx(float(np.percentile(xs, p * 100)), abs=1e-9)


def test_selected_quantiles_between_closed_brackets(spark, monkeypatch):
    """Many rows against a coarse sketch: ranks are found inside closed brackets,
    with a hot value, a null group, an empty group and repeated probabilities."""
    from lodestar.operators import selection
    monkeypatch.setattr(selection, "ACCURACY", 200)
    monkeypatch.setattr(selection, "SPAN", 5 / 200)
    monkeypatch.setattr(selection, "EXACT", 500)
    r = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 20_000), (None, 5_000), ("small", 7)) for v in
            np.where(r.random(n) < 1 / 3, 5.0, np.round(r.normal(0, 10, n), 1))] + [("empty", None)] * 3 + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.5, 0.0, 1.0, 0.123, 0.9, 0.5, 0.35, 0.61, 0.77, 0.02]
    for p in (probs[:6], probs):                              # compared one by one, and in a loop
        got = {(x.g, x.p_index): x.q for x in selection.select_quantiles(df, "v", p, ["g"]).collect()}
        assert len(got) == 3 * len(p)
        for g in ("a", None, "small"):
            xs = [v for k, v in rows if k == g and v is not None]
            assert [got[g, i] for i in range(len(p))] == pytest.approx(np.percentile(xs, [100 * x for x in p]).tolist(), abs=1e-9)
    whole = {x.p_index: x.q for x in selection.select_quantiles(df, "v", [0.25, 0.5], []).collect()}
    xs = [v for _, v in rows if v is not None]
    assert [whole[0], whole[1]] == pytest.approx(np.percentile(xs, [25, 50]).tolist(), abs=1e-9)
    assert selection.select_quantiles(df.where("v is null"), "v", [0.5], []).collect() == []


def test_regression_of_many_predictors_equals_least_squares(spark):
    from lodestar.operators import regression as rg
    r = np.random.default_rng(6)
    n = 400
    x, g, h = r.normal(1e4, 5, (n, 2)), r.integers(0, 4, n), r.integers(0, 3, n)
    y = 1e6 + x @ [3.0, -2.0] + np.array([0, 5, -5, 9.0])[g] + 2.0 * h + r.normal(0, 1, n)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), "g %d" % g[i], "h-%d" % h[i], float(y[i])) for i in range(n)]
    rows += [(n, None, 1.0, "g 0", "h-0", 1.0), (n + 1, 1.0, 1.0, None, "h-0", 1.0)]           # incomplete rows are left out
    df = spark.createDataFrame(rows, "id long, a double, b double, g string, h string, y double").repartition(5)
    d = rg.fit_design(df, ["a", "b"], ["g", "h"], "y")
    assert d.names == ["a", "b", "g_g_1", "g_g_2", "g_g_3", "h_h_1", "h_h_2"]
    z = np.column_stack([np.ones(n), x - x.mean(axis=0), *[g == k for k in (1, 2, 3)], *[h == k for k in (1, 2)]])
    want = np.linalg.lstsq(z, y, rcond=None)[0]
    want[0] -= want[1:3] @ x.mean(axis=0)
    got = {x.term: x.coef for x in rg.solve_each(rg.cross_moments(df, d, F.lit(0)), d).collect()}
    assert [got[t] for t in ["intercept", *d.names]] == pytest.approx(want.tolist(), rel=1e-8)
    ci = {x.term: x for x in rg.coefficient_intervals(df, d, "id", 50).collect()}
    assert all(c.ci_lower < c.value < c.ci_upper for c in ci.values()) and ci["a"].significant
    # replicates of the numpy kernel and of the column expressions draw the same weights
    m = {(x.g, x.i, x.j): x.value for x in rg.replicate_moments(df, d, "id", 3).where("i = 0 and j = 0").collect()}
    sums = {x.rep: x.s for x in rs.replicate_sums(df.where(f"id < {n}"), "id", 3, {"s": F.lit(1.0)}).collect()}
    assert {k: m[k, 0, 0] for k in range(3)} == sums


def test_three_rows_keep_the_original_coefficients(spark):
    from lodestar.operators import models as md
    from lodestar.operators import regression as rg
    df = spark.createDataFrame([(1, 1.0, "a", 2.0), (2, 2.0, "a", 4.0), (3, 3.0, "b", 7.0)], "id long, x double, g string, y double")
    d = rg.fit_design(df, ["x"], ["g"], "y")
    ci = {r.term: r for r in rg.coefficient_intervals(df, d, "id", 100).collect()}
    assert ci["x"].value == pytest.approx(2.0) and all(r.ci_lower is not None for r in ci.values())
    flat = df.withColumn("y", F.lit(1.0))
    assert md.point_metrics(flat.withColumn("p", F.lit(1.0)), "y", "p").first().r2 is None
    same = df.withColumn("x", F.lit(1.0))                        # constant predictors: the smallest solution
    got = {r.term: r.value for r in rg.coefficient_intervals(same, rg.fit_design(same, ["x"], [], "y"), "id", 5).collect()}
    assert got["x"] == 0.0 and got["intercept"] == pytest.approx(13 / 3)


def test_too_many_categories_are_refused(spark, monkeypatch):
    from lodestar.operators import regression as rg
    df = spark.range(500).selectExpr("id", "cast(id as string) as g", "cast(id as double) as y")
    with pytest.raises(ValueError, match="predictors"):
        rg.fit_design(df, [], ["g"], "y")
    monkeypatch.setattr(rg, "CELLS", 100)
    with pytest.raises(ValueError, match="combinations"):
        rg.fit_design(df, [], ["g"], "y")
