"""Search budget, early stopping and failure semantics (K7-K11), refit intervals
(I6/L14), the model matrix (J12) and stored models (K12) on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestar.operators import categories as ct
from lodestar.operators import transform as tf
from lodestar.operators import trees as tr

NUMERIC, ONE_HOT, LABELS = ["x1", "x2", "missing_col"], ["c"], ["l"]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, float(i % 7), float(i % 5) * 2.0, "abc"[i % 3], "xy"[i % 2], 100.0 + 3.0 * (i % 7) + (i % 5))
            for i in range(300)] + [(1000, None, 1.0, "a", "x", 1.0)]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, c string, l string, y double").cache()


@pytest.fixture(scope="module")
def matrix(raw):
    d, names = tr.model_matrix(raw, NUMERIC, ONE_HOT, LABELS, "y", "id")
    return d.cache(), names


def test_model_matrix(matrix):
    d, names = matrix
    assert names == ["x1", "x2", "var_c_b", "var_c_c", "l_encoded"]   # first category dropped, absent column skipped
    got = {r.id: list(r.x) for r in d.select("id", vector_to_array("features").alias("x")).collect()}
    assert len(got) == 300                                                # the row with a null is dropped
    assert all(got[i] == [i % 7, i % 5 * 2, i % 3 == 1, i % 3 == 2, i % 2] for i in range(300))


def test_unseen_and_null_categories(spark, raw):
    m = tr.Matrix.fit(raw.na.drop(), NUMERIC, ONE_HOT, LABELS)
    new = spark.createDataFrame([(1, 1.0, 2.0, "zzz", "y", None), (2, 1.0, 2.0, None, "?", None), (3, 1.0, 2.0, "c", None, None)], raw.schema)
    got = {r.id: list(r.x) for r in m.transform(new).select("id", vector_to_array("features").alias("x")).collect()}
    assert got == {1: [1, 2, 0, 0, 1], 2: [1, 2, 0, 0, -1], 3: [1, 2, 0, 1, -1]}


def test_a_column_of_one_category_adds_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a")], "id long, y double, c string")
    d, names = tr.model_matrix(df.withColumn("x", F.col("y")), ["x"], ["c"], [], "y", "id")
    assert names == ["x"] and [list(r.x) for r in d.orderBy("id").select(vector_to_array("features").alias("x")).collect()] == [[1], [2]]


def test_a_million_categories(spark):
    """Ranked and joined without a category on the driver; one-hot entries only
    up to a checked number."""
    n = 1_000_000
    df = spark.range(n).select("id", F.format_string("v%07d", F.col("id")).alias("c"), F.lit(1.0).alias("y"))
    m = tr.Matrix.fit(df, [], [], ["c"])
    got = m.transform(df).select(vector_to_array("features")[0].alias("x"), "id").agg(F.count_if(F.col("x") != F.col("id")).alias("bad"), F.count("x").alias("n")).first()
    assert (got.bad, got.n) == (0, n) and m.names() == ["c_encoded"]
    with pytest.raises(ValueError, match="label-encode"):
        tr.Matrix.fit(df, [], ["c"], [])


def test_label_encoding_casts_to_text_and_drops_nulls(spark):
    df = spark.createDataFrame([(1, 10), (2, 9), (3, None), (4, 10)], "id long, v int")
    assert [tuple(r) for r in tf.label_encode(df, "v").orderBy("id").collect()] == [(1, 10, 0.0), (2, 9, 1.0), (4, 10, 0.0)]      # '10' < '9'
    assert [r.idx for r in ct.fit_categories(df, ["v"]).orderBy("idx").collect()] == [0, 1]


def test_wide_dummies_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tf, "MAX_DUMMIES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        tf.one_hot_drop_first(spark.range(11).select(F.col("id").cast("string").alias("c")), "c")


def test_best_round_waits_for_a_better_one():
    assert tr.best_round([5.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3], patience=3) == 4
    assert tr.best_round([5.0, 4.0, 4.5, 4.6, 4.7, 3.0], patience=3) == 2       # stopped before the better one
    assert tr.best_round([1.0], patience=30) == 1


def test_early_stopping_chooses_a_round_below_the_maximum(spark):
    r = np.random.default_rng(0)
    rows = [(i, float(x), float(3 * x + r.normal(0, 5))) for i, x in enumerate(r.uniform(0, 10, 400))]
    d, _ = tr.model_matrix(spark.createDataFrame(rows, "id long, x double, y double"), ["x"], [], [], "y", "id")
    d = d.cache()
    errors, chosen = tr.boost_with_stopping({"stepSize": 0.3, "maxDepth": 4}, d.where("id % 2 = 0"), d.where("id % 2 = 1"), "y", rounds=40, patience=10)
    assert len(errors) == 40 and chosen < 40 and errors[chosen - 1] == min(errors[:chosen + 10])
    # the error of a round is that of the model fitted with as many rounds
    m = tr.estimator("gbt", {"stepSize": 0.3, "maxDepth": 4, "maxIter": chosen}, "y").fit(d.where("id % 2 = 0"))
    e = m.transform(d.where("id % 2 = 1")).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert e == pytest.approx(errors[chosen - 1], rel=1e-9)


def test_failing_trials_score_inf_and_fall_back_to_defaults(matrix):
    d, _ = matrix
    trials, best = tr.random_search("rf", d, "id", "y", n_trials=2, timeout_s=60.0, k=3,
                                    overrides={"numTrees": 3, "maxDepth": -1})
    assert len(trials) == 2 and all(math.isinf(t["cv_rmse"]) for t in trials)
    assert best == tr.RF_DEFAULT


def test_errors_that_are_not_of_a_fit_are_raised(matrix):
    d, _ = matrix
    with pytest.raises(ValueError):
        tr.random_search("no such model", d, "id", "y", n_trials=1, timeout_s=60.0, k=3)


def test_deadline_stops_new_trials(matrix):
    d, _ = matrix
    trials, _ = tr.random_search("rf", d, "id", "y", n_trials=5, timeout_s=0.0, k=3, overrides={"numTrees": 3})
    assert trials == []


def test_search_picks_lowest_cv_rmse(matrix, monkeypatch):
    d, _ = matrix
    trials, best = tr.random_search("rf", d, "id", "y", n_trials=2, timeout_s=120.0, k=3,
                                    overrides={"numTrees": 5})
    ok = [t for t in trials if math.isfinite(t["cv_rmse"])]
    assert ok and best == min(ok, key=lambda t: t["cv_rmse"])["params"]
    monkeypatch.setattr(tr, "boost_with_stopping", lambda *a: ([3.0, 2.0], 2))
    trials, _ = tr.random_search("gbt", d, "id", "y", n_trials=1, timeout_s=120.0, k=3)
    assert trials[0]["cv_rmse"] == 2.0 and trials[0]["rounds"] == [2, 2, 2]


def test_refit_bootstrap_interval(matrix):
    d, _ = matrix
    d = d.checkpoint()
    train, test = d.where(F.col("id") % 5 != 0), d.where(F.col("id") % 5 == 0)
    params = {"numTrees": 5, "maxDepth": 4}
    out = tr.bootstrap_prediction_interval("rf", params, train, test, "id", "y", 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("Scan ExistingRDD") == 1       # one pass over the test rows
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == test.count() and all(r.n_reps == 4 for r in rows.values())
    all_p = []
    for b in range(4):
        w = train.withColumn("__w", tr.poisson1_weight(tr.hash_uniform("id", F.lit(f"boot{b}"))).cast("double")).where("__w > 0")
        all_p.append({r.id: r.prediction for r in tr.estimator("rf", params, "y", weight="__w").fit(w).transform(test).collect()})
    for i, r in rows.items():
        p = [x[i] for x in all_p]
        assert [r.pred_mean, r.pi_lower, r.pi_upper] == pytest.approx([np.mean(p), *np.percentile(p, [2.5, 97.5])])


def test_refit_interval_scores_on_all_cores(spark, matrix):
    d = matrix[0].coalesce(1).checkpoint()
    out = tr.bootstrap_prediction_interval("rf", {"numTrees": 2, "maxDepth": 2}, d, d, "id", "y", 2)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert out.count() == 300 and out.select("id").distinct().count() == 300


def test_refit_interval_when_every_replicate_fails(matrix, monkeypatch):
    d, _ = matrix
    real, calls = tr.estimator, []

    def failing(kind, params, y, weight=None):
        calls.append(weight)
        return real(kind, {**params, "maxDepth": -1} if weight else params, y, weight)
    monkeypatch.setattr(tr, "estimator", failing)
    rows = tr.bootstrap_prediction_interval("rf", {"numTrees": 2, "maxDepth": 2}, d, d, "id", "y", 2).collect()
    assert len(rows) == 300 and all(r.n_reps == 0 and r.pi_lower < r.pred_mean < r.pi_upper for r in rows)


def test_stored_model_scores_like_the_one_in_memory(spark, raw, tmp_path):
    train = raw.na.drop()
    scaler = tf.Scaler(["x1", "x2"], "robust").fit(train)
    m = tr.Matrix.fit(scaler.transform(train), NUMERIC, ONE_HOT, LABELS)
    for kind, params in (("rf", {"numTrees": 3, "maxDepth": 3}), ("ols", {})):
        model = tr.estimator(kind, params, "y").fit(m.transform(scaler.transform(train)))
        here = tr.Scorer(m, model, scaler)
        here.save(spark, str(tmp_path / kind))
        there = tr.Scorer.load(spark, str(tmp_path / kind))
        a, b = ({r.id: r.prediction for r in s.score(train.drop("y"), "id").collect()} for s in (here, there))
        assert len(a) == 300 and a == b
        assert there.score(train.drop("x1"), "id") is None                    # a missing column
    with pytest.raises(tf.NotFittedError):                                      # any other error is raised
        tr.Scorer(m, model, tf.Scaler(["x1"], "robust")).score(train, "id")


def test_many_rows_are_put_together(spark, monkeypatch):
    """A fit of many rows reads a bounded number of weighted blocks that hold all rows,
    and what comes out is close to a fit of the rows."""
    d = spark.range(40_000).select("id", (F.col("id") % 1009 / 7.0).alias("x1"), (F.col("id") % 5).cast("double").alias("x2"))
    d = d.withColumn("y", F.col("x1") * 3 + F.col("x2") * 20 + F.hash("id") % 10)
    d, names = tr.model_matrix(d, ["x1", "x2"], [], [], "y", "id")
    d = d.checkpoint()
    params = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 50}
    plain = tr.fit("gbt", params, d, "y")
    monkeypatch.setattr(tr, "FIT_ROWS", 1000)
    seen, real = [], tr.estimator
    monkeypatch.setattr(tr, "estimator", lambda *a, **k: seen.append(a[1]) or real(*a, **k))
    blocks = tr.Blocks.of(d, "y", F.col("id") % 3)
    n, w, total = blocks.table.agg(F.count("*"), F.sum("__w"), F.sum(F.col("y") * F.col("__w"))).first()
    assert n <= tr.BINS * 5 * tr.BLOCKS * 3 and w == 40_000
    assert total == pytest.approx(d.agg(F.sum("y")).first()[0], rel=1e-12)
    m = tr.fit("gbt", params, d, "y")
    assert isinstance(m, tr.Binned) and seen[-1]["minWeightFractionPerNode"] == pytest.approx(49.5 / 40_000)
    near, far = (x.transform(d).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0] for x in (m, plain))
    assert near == pytest.approx(far, rel=0.1)
    assert m.evaluateEachIteration(d, "squared")[-1] == pytest.approx(near ** 2)
    # errors of a fold from its blocks are those of its rows
    m = blocks.fit("gbt", params, without=1)
    rows = [math.sqrt(e) for e in m.evaluateEachIteration(d.where("id % 3 = 1"), "squared")]
    assert blocks.round_errors(m, 1) == pytest.approx(rows)
    m = blocks.fit("rf", {"numTrees": 3, "maxDepth": 4}, without=1)
    held = m.transform(d.where("id % 3 = 1")).agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert blocks.rmse(m, 1) == pytest.approx(held)


def test_blocks_keep_least_rows_and_refuse_what_spark_refuses(spark, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 10)
    d, _ = tr.model_matrix(spark.range(100).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")), ["x"], [], [], "y", "id")
    m = tr.fit("rf", {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 60, "bootstrap": False}, d, "y")
    assert m.transform(d).select("prediction").distinct().count() == 1
    m = tr.fit("rf", {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 20, "bootstrap": False}, d, "y")
    assert m.transform(d).groupBy("prediction").count().agg(F.min("count")).first()[0] >= 20
    bad, _ = tr.model_matrix(spark.range(100).select("id", F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id")).alias("x"), F.lit(1.0).alias("y")), ["x"], [], [], "y", "id")
    with pytest.raises(tr.FIT_ERRORS):
        tr.fit("rf", {"numTrees": 1}, bad, "y")


@pytest.mark.parametrize("kind, params", [("rf", {"numTrees": 1, "maxDepth": 2, "bootstrap": False, "featureSubsetStrategy": "all"}),
                                          ("gbt", {"maxIter": 5, "maxDepth": 2, "stepSize": 0.5})])
def test_blocks_split_numbers_by_a_threshold(spark, monkeypatch, kind, params):
    """A bin is a number, not a category: where no draw is made, a fit of blocks is the fit
    of the rows, also where the target goes up and down with a feature."""
    d = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"))
    d = d.withColumn("y", F.col("x1") % 2 * 50 + F.col("x1") * F.col("x1") + F.col("x2") * 3)
    d, _ = tr.model_matrix(d, ["x1", "x2"], [], [], "y", "id")
    d = d.checkpoint()
    plain = tr.fit(kind, params, d, "y")
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    put_together = tr.fit(kind, params, d, "y")
    assert isinstance(put_together, tr.Binned)
    both = [{r.id: r.prediction for r in m.transform(d).collect()} for m in (plain, put_together)]
    assert both[1] == pytest.approx(both[0])
    assert list(put_together.featureImportances.toArray()) == pytest.approx(list(plain.featureImportances.toArray()))


def test_folds_after_a_search_are_its_best_trials_fits(spark, monkeypatch):
    """The folds of the best parameters are not fitted a second time, the models of
    other trials are let go, and a final fit reads the blocks of all folds."""
    monkeypatch.setattr(tr, "FIT_ROWS", 500)
    monkeypatch.setattr(tr, "SEARCH_ROUNDS", 4)
    d = spark.range(2000).select("id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 * 2 + F.col("id") % 3).cast("double").alias("y"))
    d, _ = tr.model_matrix(d, ["x"], [], [], "y", "id")
    d = d.checkpoint()
    blocks = tr.Blocks.of(d, "y", tr.hash_fold("id", 3, seed=tr.SEED))
    fits, real = [], tr.Blocks._fit
    monkeypatch.setattr(tr.Blocks, "_fit", lambda self, kind, params, without: fits.append(without) or real(self, kind, params, without))
    over = {"minInstancesPerNode": 5, "minInfoGain": 0.0}
    trials, best = tr.random_search("gbt", d, "id", "y", n_trials=3, timeout_s=60.0, k=3, overrides=over, blocks=blocks)
    assert sorted(fits) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and len(trials) == 3
    assert set(blocks.fitted) == {(*blocks._at("gbt", tr.search_params("gbt", best)), f) for f in range(3)}
    got = {(r.fold, r.id): r.prediction for r in tr.fold_predictions("gbt", tr.search_params("gbt", best), d, "id", "y", 3, blocks=blocks).collect()}
    assert len(fits) == 9 and len(got) == 2000
    errors = [sum((got[f, r.id] - r.y) ** 2 for r in d.where(tr.hash_fold("id", 3, seed=tr.SEED) == f).collect()) for f in range(3)]
    assert sum(errors) > 0 and len({f for f, _ in got}) == 3
    m = tr.fit("rf", {"numTrees": 1, "maxDepth": 6, "bootstrap": False}, d, "y", blocks)
    alone = tr.fit("rf", {"numTrees": 1, "maxDepth": 6, "bootstrap": False}, d, "y")
    assert [r.prediction for r in m.transform(d).orderBy("id").collect()] == pytest.approx([r.prediction for r in alone.transform(d).orderBy("id").collect()])
