"""Fits of many rows from weighted blocks: each in one task, the trees Spark's (K7/K8),
and refits (I6/L14) on the blocks of their replicates."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.hashing import digest, hash_uniform, poisson1_cdf, poisson1_of_digest, poisson1_weight
from lodestar.operators import ensembles as en
from lodestar.operators import trees as tr

FOREST = {"numTrees": 1, "maxDepth": 4, "bootstrap": False, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(6000).select("id", (F.col("id") % 10).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"))
    d = d.withColumn("y", F.col("x1") % 2 * 50 + F.col("x1") * F.col("x1") + F.col("x2") * 3 + F.hash("id") % 5)
    return tr.model_matrix(d, ["x1", "x2"], [], [], "y", "id")[0].checkpoint()


def test_weights_from_digits_are_those_from_numbers(spark):
    d = spark.range(20_000).select(F.nullif("id", F.lit(7)).alias("id")).withColumn("d", digest("id", F.lit("boot3")))
    a, b = poisson1_of_digest(F.col("d")), poisson1_weight(hash_uniform("id", "boot3"))
    got = d.select(a.alias("a"), b.alias("b")).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))), F.max("a"), F.avg("b")).first()
    assert got[0] == 0 and got[1] > 4 and got[2] == pytest.approx(1, abs=0.03)
    # on both sides of each step of the CDF
    steps = sorted({h for c in poisson1_cdf() for h in range(int(c * 2 ** 32) - 2, int(c * 2 ** 32) + 3) if 0 <= h < 2 ** 32})
    d = spark.createDataFrame([(f"{h:08x}" + "0" * 24, h) for h in steps], "d string, h long")
    assert [r for r in d.select("h", poisson1_of_digest(F.col("d")).alias("a"), poisson1_weight(F.col("h") / 2.0 ** 32).alias("b")).collect() if r.a != r.b] == []


def test_replicates_hold_the_weights_of_all_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    reps = tr.LANES + 2
    blocks = tr.Replicates.of(rows, "y", "id", reps)
    got = {r["__rep"]: r for r in blocks.table.groupBy("__rep").agg(F.sum("__w").alias("w"), F.sum(F.col("y") * F.col("__w")).alias("s"), F.count("*").alias("n"), F.min("__w").alias("least")).collect()}
    assert set(got) == set(range(reps))
    for b in range(reps):
        w = poisson1_weight(hash_uniform("id", f"boot{b}"))
        weight, total = rows.agg(F.sum(w), F.sum(w * F.col("y"))).first()
        assert got[b].w == weight and got[b].s == pytest.approx(total, rel=1e-12)
        assert got[b].n <= 70 * tr.BLOCKS and got[b].least > 0


def test_refits_of_blocks_are_refits_of_the_rows(spark, rows, monkeypatch):
    """Where the forest makes no draw, the interval of many rows is that of the rows."""
    train, test = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    plain = {r.id: r for r in tr.bootstrap_prediction_interval("rf", FOREST, train, test, "id", "y", 6).collect()}
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    fitted, real = [], en.Ensemble.fit.__func__
    monkeypatch.setattr(en.Ensemble, "fit", classmethod(lambda cls, e, d, *a: fitted.append(d.count()) or real(cls, e, d, *a)))
    out = tr.bootstrap_prediction_interval("rf", FOREST, train, test, "id", "y", 6)
    assert len(fitted) == 6 and max(fitted) <= 70 * tr.BLOCKS         # no fit reads the rows
    got = out.collect()
    assert len(got) == len(plain) == 1500
    for r in got:
        p = plain[r.id]
        assert (r.y, r.n_reps) == (p.y, 6) and [r.pred_mean, r.pi_lower, r.pi_upper] == pytest.approx([p.pred_mean, p.pi_lower, p.pi_upper])


def test_rows_that_come_twice_and_without_key(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    twice = rows.unionByName(rows).withColumn("id", F.nullif("id", F.lit(3)))
    out = tr.bootstrap_prediction_interval("rf", FOREST, twice, twice, "id", "y", 2)
    assert out.count() == 12_000 and out.where("id is null").count() == 2 and out.where("pred_mean is null").count() == 0


def test_refits_that_all_fail_fall_back(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    monkeypatch.setattr(tr.Replicates, "refit", lambda self, kind, params, b: self._fit(kind, {**params, "maxDepth": -1}, b))
    got = tr.bootstrap_prediction_interval("rf", FOREST, rows, rows, "id", "y", 2).collect()
    assert len(got) == 6000 and all(r.n_reps == 0 and r.pi_lower < r.pred_mean < r.pi_upper for r in got)


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_are_not_jobs(spark, rows, monkeypatch):
    """A boosting fit of blocks takes as many Spark jobs for 40 rounds as for two."""
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    blocks = tr.Blocks.of(rows, "y", F.col("id") % 3)
    params = {"maxDepth": 3, "subsamplingRate": 0.8, "stepSize": 0.1, "featureSubsetStrategy": "0.6"}
    few, many = (_jobs(spark, lambda m=m, f=f: blocks.fit("gbt", {**params, "maxIter": m}, without=f)) for m, f in ((2, 0), (40, 1)))
    assert many[1] == few[1] and len(many[0].model.trees) == 40
    errors = blocks.round_errors(many[0], 1)
    assert len(errors) == 40 and errors[-1] < errors[0] / 2


def test_draws_do_not_depend_on_the_order_of_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    for kind, params in (("gbt", {"maxIter": 5, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.5"}), ("rf", {"numTrees": 5})):
        a, b = (tr.fit(kind, params, d, "y").model for d in (rows, rows.repartition(3, "y")))
        assert all(np.array_equal(s.feature, t.feature) and np.array_equal(s.cut, t.cut) and s.value == pytest.approx(t.value) for s, t in zip(a.trees, b.trees))
        assert len({tuple(t.value) for t in a.trees}) == 5


def test_beyond_the_bound_of_a_task_fits_are_sparks(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.5}
    here = tr.fit("gbt", params, rows, "y")
    monkeypatch.setattr(tr, "FIT_ENTRIES", 0)
    spark_s = tr.fit("gbt", params, rows, "y")
    assert isinstance(here.model, en.Ensemble) and not isinstance(spark_s.model, en.Ensemble)
    a, b = ({r.id: r.prediction for r in m.transform(rows).collect()} for m in (here, spark_s))
    assert a == pytest.approx(b)
    assert here.evaluateEachIteration(rows, "squared") == pytest.approx(spark_s.evaluateEachIteration(rows, "squared"))
    assert list(here.featureImportances.toArray()) == pytest.approx(list(spark_s.featureImportances.toArray()))


def test_what_spark_refuses_is_refused(spark, rows, monkeypatch):
    monkeypatch.setattr(tr, "FIT_ROWS", 100)
    for kind, params in (("rf", {"maxDepth": -1}), ("rf", {"numTrees": 0}), ("gbt", {"featureSubsetStrategy": "none"}), ("gbt", {"subsamplingRate": 0.0}), ("rf", {"minInstancesPerNode": 0})):
        with pytest.raises(tr.FIT_ERRORS):
            tr.fit(kind, params, rows, "y")
    with pytest.raises(tr.FIT_ERRORS):
        tr.fit("rf", FOREST, rows.withColumn("y", F.nullif("y", F.lit(3.0))), "y")


def test_features_a_node():
    assert [en.features_a_node(s, 7, False) for s in ("auto", "all", "onethird", "sqrt", "log2", "0.5", "1.0", "3", "30", "x", "1.5")] == [3, 7, 3, 3, 3, 4, 7, 3, 7, 0, 0]
    assert en.features_a_node("auto", 7, True) == 7
