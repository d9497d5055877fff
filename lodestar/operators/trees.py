"""Tree ensembles, hyperparameter search and refit-bootstrap intervals (2K
K7-K13, 2I I6, 2L L4/L14).

Fits are Spark ML estimators (distributed: per-iteration histogram
aggregation over the partitions); the driver only loops over trials, folds
and replicates, each of which is a distributed job.  Folds, trial samples and
bootstrap weights are keyed hashes / seeded draws, so a re-run gives the same
work.  Boosted trees are Spark's level-wise GBT, not the reference's
leaf-wise engine: parameters are mapped where an equivalent exists (see
``GBT_PARAM_MAP``) and the numbers agree only within a band.
"""

from __future__ import annotations

import json
import logging
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import digest, hash_uniform, poisson1_of_digest, poisson1_weight
from lodestar.functions.stats import t_ppf
from lodestar.operators.categories import encode, fit_categories, one_hot_stage, rotated
from lodestar.operators.ensembles import KNOWN, Ensemble
from lodestar.operators.models import r_squared
from lodestar.operators.resample import hash_fold
from lodestar.operators.transform import Scaler
from lodestar.session import scratch_path

log = logging.getLogger(__name__)
FIT_ERRORS = (PySparkException, Py4JJavaError)      # what a fit on unsuitable data or parameters raises

# Search spaces and fallback parameters (scaled to the Spark
# estimators' parameter names).
GBT_PARAM_MAP = {"num_boost_round": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
                 "bagging_fraction": "subsamplingRate", "feature_fraction": "featureSubsetStrategy",
                 "min_data_in_leaf": "minInstancesPerNode", "min_gain_to_split": "minInfoGain"}
GBT_SPACE = {"stepSize": ("float", 0.01, 0.15), "maxDepth": ("int", 3, 6), "subsamplingRate": ("float", 0.6, 0.9),
             "featureSubsetStrategy": ("fraction", 0.6, 0.9), "minInstancesPerNode": ("int", 20, 60),
             "minInfoGain": ("float", 0.1, 1.0)}
RF_SPACE = {"numTrees": ("int", 50, 200), "maxDepth": ("int", 3, 10), "minInstancesPerNode": ("int", 8, 25),
            "featureSubsetStrategy": ("choice", ["sqrt", "log2", "0.5", "0.7"])}
GBT_DEFAULT = {"maxIter": 100, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.8,
               "featureSubsetStrategy": "all", "minInstancesPerNode": 30, "minInfoGain": 0.5}
RF_DEFAULT = {"numTrees": 100, "maxDepth": 6, "minInstancesPerNode": 12, "featureSubsetStrategy": "sqrt"}
SEED = 42
SEARCH_ROUNDS, FINAL_ROUNDS, PATIENCE = 200, 300, 30      # boosting rounds of a trial and of the final fit; rounds without a better one
FIT_ROWS = 1 << 16        # more training rows than these are put together before a fit
LONE_FIT_ROWS = 1 << 14   # blocks a task of a boosting fit that has no others beside it
BINS = 32                 # values of a feature that Spark's trees tell apart (their maxBins)
BLOCKS = 16               # blocks of rows with equal bins; a round's or tree's draw takes or leaves a block
BINNED_FEATURES = 200     # wider matrices are fitted row by row
FIT_ENTRIES = 1 << 22     # blocks times features that one task fits
LANES = 5                 # replicates whose weights are made beside each other; many more make code that the JVM does not compile


class Matrix:
    """Fitted model matrix over the columns that exist: numeric ones,
    one-hot ones (first category dropped) and label-encoded ones, assembled into
    ``features``.  Category tables stay distributed."""

    def __init__(self, numeric: list[str], one_hot: list[str], labels: list[str], table: DataFrame | None,
                 stages: PipelineModel, sizes: dict[str, int]):
        self.numeric, self.one_hot, self.labels = numeric, one_hot, labels
        self.table, self.stages, self.sizes = table, stages, sizes

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], one_hot: list[str], labels: list[str]) -> "Matrix":
        numeric, one_hot, labels = ([c for c in cols if c in df.columns] for cols in (numeric, one_hot, labels))
        table = fit_categories(df, [*one_hot, *labels]) if one_hot or labels else None
        stages, sizes, inputs = [], {}, list(numeric)
        for c in one_hot:
            stage, sizes[c] = one_hot_stage(c, table, f"__i_{c}", f"__v_{c}")
            if stage is not None:
                stages.append(stage)
                inputs.append(f"__v_{c}")
        stages.append(VectorAssembler(inputCols=[*inputs, *[f"{c}_encoded" for c in labels]], outputCol="features"))
        return cls(numeric, one_hot, labels, table, PipelineModel(stages), sizes)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.one_hot, *self.labels]

    def names(self, limit: int = 1000) -> list[str]:
        """Names of the entries of ``features``; beyond ``limit`` categories a
        one-hot column's entries are named by their index."""
        out = list(self.numeric)
        for c in self.one_hot:
            if self.sizes[c] > limit:
                out += [f"var_{c}_{i}" for i in range(1, self.sizes[c])]
            else:
                values = self.table.where((F.col("column") == c) & (F.col("idx") > 0)).orderBy("idx").select("category").collect()
                out += [f"var_{c}_{r[0]}".replace(" ", "_").replace("-", "_") for r in values]
        return out + [f"{c}_encoded" for c in self.labels]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``features``."""
        keep = df.columns
        d = df.select("*", *[F.col(c).cast("double").alias(f"__n_{c}") for c in self.numeric])
        for c in self.one_hot:
            d = encode(d, c, self.table, f"__i_{c}").withColumn(f"__i_{c}", rotated(F.col(f"__i_{c}"), max(1, self.sizes[c])))
        for c in self.labels:
            d = encode(d, c, self.table, f"{c}_encoded")
        d = d.drop(*self.numeric).withColumnsRenamed({f"__n_{c}": c for c in self.numeric})
        rest = [c for c in keep if c != "features" and c not in self.numeric]
        out = self.stages.transform(d).select(*rest, *[F.col(c) for c in self.numeric], "features")
        return out.select(*[c for c in keep if c != "features"], "features")


def model_matrix(df: DataFrame, numeric: list[str], one_hot: list[str], labels: list[str], y: str,
                 key: str, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(key, keep..., y, features) of the rows without a null in any used
    column, and the names of the features."""
    used = [c for c in dict.fromkeys([*numeric, *one_hot, *labels]) if c in df.columns]
    d = df.na.drop("any", subset=[*used, y]).withColumn(y, F.col(y).cast("double"))
    m = Matrix.fit(d, numeric, one_hot, labels)
    return m.transform(d).select(key, *(keep or []), y, "features"), m.names()


def estimator(kind: str, params: dict, label: str, weight: str | None = None):
    """K7/K8: a Spark ML regressor with the given parameters (``ols``: plain least squares)."""
    p = dict(params)
    common = {"featuresCol": "features", "labelCol": label, "seed": SEED}
    if weight:
        common["weightCol"] = weight
    if kind == "gbt":
        return GBTRegressor(**common, checkpointInterval=10, **p)
    if kind == "rf":
        return RandomForestRegressor(**common, **p)
    if kind == "ols":
        return LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0, **p)
    raise ValueError(kind)


class Bins:
    """For each entry of ``features``, the values at which its next bin begins: every
    value but the least where there are at most ``BINS``, else quantiles of all rows."""

    def __init__(self, starts: list[list[float]]):
        self.starts = starts
        self.columns = [f"__b{i}" for i in range(len(starts))]

    @staticmethod
    def entries(df: DataFrame, width: int) -> DataFrame:
        d = df.withColumn("__x", vector_to_array("features"))
        return d.select(*df.columns, *[F.col("__x")[i].alias(f"__x{i}") for i in range(width)])

    @classmethod
    def fit(cls, df: DataFrame, width: int) -> "Bins":
        d, cols = cls.entries(df.select("features"), width), [f"__x{i}" for i in range(width)]
        counts = d.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
        few = [c for c in cols if counts[c] <= 2 * BINS]
        values = d.agg(F.lit(0), *[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first()
        many = [c for c in cols if c not in few or len(values[c]) > BINS]
        cuts = dict(zip(many, d.approxQuantile(many, [i / BINS for i in range(1, BINS)], 1e-3))) if many else {}
        return cls([sorted(set(cuts[c])) if c in cuts else values[c][1:] for c in cols])

    def number(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        """``df`` plus the number of each entry's bin.  As in Spark's own trees, values
        that are not finite are an error in a fit and large or small ones afterwards."""
        edge, entries = float("inf"), [f"__x{i}" for i in range(len(self.starts))]
        d = self.entries(df, len(self.starts))
        if fitting:
            d = d.withColumns({c: F.when(F.abs(c) == edge, float("nan")).otherwise(F.col(c)) for c in entries})
        b = Bucketizer(splitsArray=[[-edge, *[v for v in s if abs(v) < edge], edge] for s in self.starts],
                       handleInvalid="error" if fitting else "keep", inputCols=entries, outputCols=self.columns)
        # without the Bucketizer's attributes, by which Spark's trees would take a bin for an unordered category
        return b.transform(d).select(*df.columns, *[F.col(c).alias(c, metadata={}) for c in self.columns])

    def assemble(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``features`` from the numbers of the bins, which go unless ``keep``."""
        d = VectorAssembler(inputCols=self.columns, outputCol="__f", handleInvalid="keep").transform(df.drop("features"))
        return (d if keep else d.drop(*self.columns)).withColumnRenamed("__f", "features")


class Binned:
    """A model of binned features, used on rows like one of the features themselves."""

    def __init__(self, bins: Bins, model):
        self.bins, self.model = bins, model

    def transform(self, df: DataFrame) -> DataFrame:
        d = self.bins.number(df).withColumnRenamed("features", "__raw")
        return self.model.transform(self.bins.assemble(d)).drop("features").withColumnRenamed("__raw", "features").select(*df.columns, "prediction")

    @property
    def featureImportances(self):
        return self.model.featureImportances

    def evaluateEachIteration(self, df: DataFrame, loss: str):
        return self.model.evaluateEachIteration(self.bins.assemble(self.bins.number(df.withColumn("__w", F.lit(1.0)))), loss)


class Blocks:
    """Rows put together for fits.  Trees see a feature only by its bin: the rows
    of a fold with equal bins are dealt to ``BLOCKS`` blocks by a hash of their other
    columns, and a block is one row with their mean, number (``__w``) and squares about
    the mean (``__ss``), so rounds and trees cost the same for any number of rows.  All
    rows count; the gain of a split is that of the rows themselves, as what a block's rows
    differ by stands in both sides of it.  A draw (``subsamplingRate``, bootstrap) is of
    blocks.  Up to ``FIT_ENTRIES`` bins of blocks a fit is one task, beyond that
    Spark's own distributed trees.  Models of all folds but one are kept until ``forget``:
    the fits of a search's best trial are those of the cross-validation after it."""

    def __init__(self, bins: Bins, table: DataFrame, y: str, folded: bool):
        self.bins, self.table, self.y, self.folded = bins, table, y, folded
        self.fitted: dict[tuple, Binned] = {}
        self.parts: dict[int | None, tuple] = {}
        self.lock = Lock()

    @staticmethod
    def numbered(d: DataFrame, fold: Column | None = None) -> tuple[Bins, DataFrame] | None:
        """The rows with their bins, ``__fold`` and ``__block``; None for up to ``FIT_ROWS``
        rows and for wide matrices: those are fitted as they are."""
        if d.count() <= FIT_ROWS:
            return None
        width = len(d.select(vector_to_array("features")).first()[0])
        if width > BINNED_FEATURES:
            return None
        bins, rest = Bins.fit(d, width), [c for c in d.columns if c != "features"]
        x = d.withColumns({"__fold": F.lit(0) if fold is None else fold, "__block": F.pmod(F.xxhash64(*rest), F.lit(BLOCKS))})
        return bins, bins.number(x, fitting=True).drop("features")

    @classmethod
    def of(cls, d: DataFrame, y: str, fold: Column | None = None) -> "Blocks | None":
        found, n = cls.numbered(d, fold), F.count(F.lit(1))
        if found is None:
            return None
        bins, x = found
        table = x.groupBy("__fold", *bins.columns, "__block").agg(
            F.when(F.count(y) == n, F.avg(y)).alias(y), n.cast("double").alias("__w"), (F.var_pop(y) * n).alias("__ss"))
        return cls(bins, table.checkpoint(), y, fold is not None)

    @staticmethod
    def _at(kind: str, params: dict) -> tuple:
        return kind, json.dumps(params, sort_keys=True)

    def forget(self, kind: str, params: dict) -> None:
        """Lets go of the models of these parameters."""
        for at in [a for a in list(self.fitted) if a[:2] == self._at(kind, params)]:
            self.fitted.pop(at, None)

    def fit(self, kind: str, params: dict, without: int | None = None) -> Binned:
        """An ensemble of the blocks of all folds but ``without``."""
        at = (*self._at(kind, params), without)
        model = self.fitted.get(at) or self._fit(kind, params, without)
        if without is not None:
            self.fitted[at] = model
        return model

    def _rows(self, without: int | None) -> DataFrame:
        """Blocks of all folds but ``without``."""
        if not self.folded:
            return self.table
        y, d = self.y, self.table.where(F.lit(True) if without is None else F.col("__fold") != without)
        mean = F.when(F.count(y) == F.count(F.lit(1)), F.sum(F.col(y) * F.col("__w")) / F.sum("__w"))
        return d.groupBy(*self.bins.columns, "__block").agg(mean.alias(y), F.sum("__w").alias("__w")).checkpoint()

    def _part(self, without: int | None) -> tuple[DataFrame, int, float]:
        """``_rows``, their number and that of the rows in them, once for all fits that read them."""
        with self.lock:
            if without not in self.parts:
                d = self._rows(without)
                self.parts[without] = (d, *d.agg(F.count(F.lit(1)), F.sum("__w")).first())
            return self.parts[without]

    def _fit(self, kind: str, params: dict, without: int | None) -> Binned:
        """``minInstancesPerNode`` is kept in rows, as a share of the weight."""
        d, blocks, rows = self._part(without)
        least = params.get("minInstancesPerNode", 1)
        own = {**params, "minInstancesPerNode": min(1, least), "minWeightFractionPerNode": min(max(0.0, (least - 0.5) / rows), 0.4)}
        if 2 * least > rows:                             # no split leaves that many on both sides
            own["maxDepth"] = 0
        e, cols = estimator(kind, own, self.y, weight="__w"), self.bins.columns
        if kind in ("rf", "gbt") and set(own) <= KNOWN and least >= 1 and blocks * len(cols) <= FIT_ENTRIES:
            return Binned(self.bins, Ensemble.fit(e, d, cols, "__block", self.y, "__w"))
        d = self.bins.assemble(d.select(self.y, "__w", *cols)).checkpoint()
        if kind == "gbt":                                # a round is several small jobs: few tasks each
            d = d.coalesce(-(-blocks // (FIT_ROWS if without is not None else LONE_FIT_ROWS)))
        return Binned(self.bins, e.fit(d))

    def held_out(self, f: int) -> tuple[DataFrame, float]:
        """Blocks of fold ``f`` and the mean square that no prediction of a block can lessen."""
        d = self.table.where(F.col("__fold") == f)
        return self.bins.assemble(d), d.agg(F.sum("__ss") / F.sum("__w")).first()[0]

    def round_errors(self, m: Binned, f: int) -> list[float]:
        """RMSE over the rows of fold ``f`` after each round."""
        d, within = self.held_out(f)
        return [math.sqrt(e + within) for e in m.model.evaluateEachIteration(d, "squared")]

    def rmse(self, m: Binned, f: int) -> float:
        d, within = self.held_out(f)
        e = F.col(self.y) - F.col("prediction")
        return math.sqrt(m.model.transform(d).agg(F.sum(e * e * F.col("__w")) / F.sum("__w")).first()[0] + within)


def fit(kind: str, params: dict, train: DataFrame, y: str, blocks: Blocks | None = None):
    """An ensemble fitted on ``train``, put together to blocks where they are many rows."""
    blocks = blocks or Blocks.of(train, y)
    return estimator(kind, params, y).fit(train) if blocks is None else blocks.fit(kind, params)


def predict(model, df: DataFrame, key: str, y: str) -> DataFrame:
    """(key, y, prediction) for new data."""
    return model.transform(df).select(key, y, "prediction")


class Scorer:
    """A fitted matrix, its scaler (if any) and a model, applied to new data
    or kept in a folder that every executor sees."""

    def __init__(self, matrix: Matrix, model, scaler: Scaler | None = None):
        self.matrix, self.model, self.scaler = matrix, model, scaler

    def score(self, df: DataFrame, key: str) -> DataFrame | None:
        """(key, prediction); None where a column of the matrix is missing, as in
        the reference.  Any other error is raised."""
        if any(c not in df.columns for c in [key, *self.matrix.columns]):
            return None
        d = df.select(key, *self.matrix.columns)
        d = self.scaler.transform(d) if self.scaler is not None else d
        return self.model.transform(self.matrix.transform(d)).select(key, "prediction")

    def save(self, spark, folder: str) -> None:
        m = self.matrix
        spec = {"numeric": m.numeric, "one_hot": m.one_hot, "labels": m.labels, "sizes": m.sizes, "tables": m.table is not None,
                "scaler": None if self.scaler is None else [self.scaler.cols, self.scaler.method]}
        spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/spec")
        PipelineModel([*m.stages.stages, self.model]).write().overwrite().save(f"{folder}/stages")
        if m.table is not None:
            m.table.write.mode("overwrite").parquet(f"{folder}/categories")
        if self.scaler is not None:
            self.scaler.params.write.mode("overwrite").parquet(f"{folder}/scaler")

    @classmethod
    def load(cls, spark, folder: str) -> "Scorer":
        spec = json.loads(spark.read.text(f"{folder}/spec").first()[0])
        stages = PipelineModel.load(f"{folder}/stages").stages
        table = spark.read.parquet(f"{folder}/categories") if spec["tables"] else None
        scaler = None
        if spec["scaler"]:
            scaler = Scaler(*spec["scaler"])
            scaler.params = spark.read.parquet(f"{folder}/scaler")
        matrix = Matrix(spec["numeric"], spec["one_hot"], spec["labels"], table, PipelineModel(stages[:-1]), spec["sizes"])
        return cls(matrix, stages[-1], scaler)


def importances(model, names: list[str], top: int = 10) -> list[tuple[str, float]]:
    """impurity/gain importances, sorted, top ``top``."""
    imp = model.featureImportances.toArray()
    pairs = sorted(zip(names, (float(v) for v in imp)), key=lambda t: (-t[1], t[0]))
    return pairs[:top]


def sample_params(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, spec in space.items():
        kind = spec[0]
        if kind == "log":
            out[name] = float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
        elif kind == "int":
            out[name] = int(rng.randint(spec[1], spec[2]))
        elif kind == "float":
            out[name] = float(rng.uniform(spec[1], spec[2]))
        elif kind == "fraction":                       # a share of the columns, as text
            out[name] = f"{rng.uniform(spec[1], spec[2]):.4f}"
        else:
            out[name] = rng.choice(spec[1])
    return out


def best_round(errors: list[float], patience: int = PATIENCE) -> int:
    """1-based round of the least error seen before ``patience`` rounds without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def boost_with_stopping(params: dict, train: DataFrame, valid: DataFrame, y: str, rounds: int = SEARCH_ROUNDS,
                        patience: int = PATIENCE) -> tuple[list[float], int]:
    """K7/K9: (validation RMSE after each round, round chosen by early stopping).

    Boosting is stagewise: the first m trees of a fit are the fit of m rounds,
    so the errors of every round come from one fit and one pass over the
    validation rows.  (Spark's own ``validationIndicatorCol`` stops at the first
    round that is not better, a patience of one.)"""
    model = fit("gbt", {**params, "maxIter": rounds}, train, y)
    errors = [math.sqrt(e) for e in model.evaluateEachIteration(valid, "squared")]
    return errors, best_round(errors, patience)


def fold_predictions(kind: str, params: dict, d: DataFrame, key: str, y: str, k: int,
                     parallelism: int | None = None, blocks: Blocks | None = None) -> DataFrame:
    """k fits on k-1 folds each, predictions of the held-out fold, unioned:
    (fold, key, y, prediction).  Fits run on a small driver thread pool so
    independent jobs overlap (like ``CrossValidator.parallelism``).  ``blocks`` are
    those of ``d`` by its folds."""
    df = d.withColumn("fold", hash_fold(key, k, seed=SEED))
    blocks = blocks or Blocks.of(d, y, hash_fold(key, k, seed=SEED))

    def one(f):
        m = estimator(kind, params, y).fit(df.where(F.col("fold") != f)) if blocks is None else blocks.fit(kind, params, without=f)
        return m.transform(df.where(F.col("fold") == f)).select("fold", key, y, "prediction")

    with ThreadPoolExecutor(max_workers=max(1, parallelism or k)) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_summary(preds: DataFrame, y: str, k: int, model_name: str) -> DataFrame:
    """L4: per-fold R^2, RMSE, MAE -> mean, sample sd, t-interval (df k-1);
    one aggregation of the fold predictions, then k rows."""
    e = F.col(y) - F.col("prediction")
    pf = preds.groupBy("fold").agg(r_squared(y, e).alias("r2"),
                                   F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    t = t_ppf(0.975, k - 1)
    aggs = []
    for m in ("r2", "rmse", "mae"):
        half = F.lit(t) * F.stddev_samp(m) / F.sqrt(F.count(F.lit(1)))
        aggs += [F.avg(m).alias(f"{m}_cv_mean"), F.stddev_samp(m).alias(f"{m}_cv_std"),
                 (F.avg(m) - half).alias(f"{m}_cv_ci_lower"), (F.avg(m) + half).alias(f"{m}_cv_ci_upper")]
    return pf.agg(*aggs).select(F.lit(model_name).alias("modelo"), "*")


def search_params(kind: str, params: dict) -> dict:
    """The parameters of a trial's fits: boosting with all rounds of a search."""
    return {**params, "maxIter": SEARCH_ROUNDS} if kind == "gbt" else params


def trial_rmse(kind: str, params: dict, d: DataFrame, key: str, y: str, k: int, blocks: Blocks | None = None) -> tuple[float, list[int]]:
    """Mean over k folds of the held-out RMSE, and for boosting the round early
    stopping chose in each fold.  ``blocks`` are those of ``d`` by its folds."""
    if blocks is not None:
        def fold(f):
            m = blocks.fit(kind, search_params(kind, params), without=f)
            if kind != "gbt":
                return blocks.rmse(m, f), None
            errors = blocks.round_errors(m, f)
            return errors[best_round(errors) - 1], best_round(errors)
        with ThreadPoolExecutor(max_workers=k) as pool:
            got = list(pool.map(fold, range(k)))
        return sum(e for e, _ in got) / k, [r for _, r in got if r]
    if kind == "gbt":
        df = d.withColumn("fold", hash_fold(key, k, seed=SEED))

        def one(f):
            return boost_with_stopping(params, df.where(F.col("fold") != f), df.where(F.col("fold") == f), y)
        with ThreadPoolExecutor(max_workers=k) as pool:
            got = list(pool.map(one, range(k)))
        return sum(errors[r - 1] for errors, r in got) / k, [r for _, r in got]
    pr = fold_predictions(kind, params, d, key, y, k)
    e = F.col(y) - F.col("prediction")
    return pr.groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("r")).agg(F.avg("r")).first()[0], []


def random_search(kind: str, d: DataFrame, key: str, y: str, n_trials: int, timeout_s: float, k: int = 3,
                  seed: int = SEED, overrides: dict | None = None, parallel_trials: int = 5,
                  blocks: Blocks | None = None) -> tuple[list[dict], dict]:
    """Seeded random search, k-fold RMSE per trial (boosting: with early
    stopping on the held-out fold); a trial whose fit fails scores inf; no
    trial is started after the deadline; if none succeeded the default
    parameters are returned.  Returns (trials, best params).

    Parameters are drawn up front in a fixed order, so the trial set does not
    depend on timing; ``parallel_trials`` trials (each with its k fold fits
    in parallel) run as concurrent Spark jobs.  ``overrides`` fix some of them.
    ``blocks`` are those of ``d`` by its folds; they keep the models of the best trial only."""
    space = GBT_SPACE if kind == "gbt" else RF_SPACE
    rng = random.Random(seed)
    plans = [{**sample_params(space, rng), **(overrides or {})} for _ in range(n_trials)]
    deadline = time.monotonic() + timeout_s
    blocks = blocks or Blocks.of(d, y, hash_fold(key, k, seed=SEED))
    lock, leader = Lock(), []                            # (RMSE, number) of the best trial so far

    def run(i):
        if time.monotonic() > deadline:
            return None
        try:
            rmse, rounds = trial_rmse(kind, plans[i], d, key, y, k, blocks)
        except FIT_ERRORS as e:
            log.warning("trial %d failed: %s", i, str(e)[:200])
            rmse, rounds = float("inf"), []
        with lock:
            now = min([*leader, (rmse, i)])
            for _, loser in {*leader, (rmse, i)} - {now}:
                if blocks is not None and plans[loser] != plans[now[1]]:
                    blocks.forget(kind, search_params(kind, plans[loser]))
            leader[:] = [now]
        return {"trial": i, "params": plans[i], "cv_rmse": float(rmse), "rounds": rounds}

    with ThreadPoolExecutor(max_workers=max(1, parallel_trials)) as pool:
        trials = [t for t in pool.map(run, range(n_trials)) if t is not None]
    ok = [t for t in trials if math.isfinite(t["cv_rmse"])]
    default = GBT_DEFAULT if kind == "gbt" else RF_DEFAULT
    best = min(ok, key=lambda t: (t["cv_rmse"], t["trial"]))["params"] if ok else dict(default)
    return trials, best


def _percentile(values, share: float):
    """Linear-interpolation percentile of a sorted array column."""
    at = F.lit(share) * (F.size(values) - 1)
    low = F.get(values, F.floor(at).cast("int"))
    return low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, checkpointed
    when that takes a shuffle: a row scored by many models costs far more than
    its way to another task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores).checkpoint()


class Replicates(Blocks):
    """Blocks of Poisson-bootstrap replicates of the rows: the same cells and deal for
    each, but the weight of a block is that of its rows in the replicate.  The rows
    are dealt by block first, so that their ``reps`` weights are made and added up where they
    are, those of ``LANES`` replicates at a time."""

    def __init__(self, bins: Bins, folder: str, y: str, spark):
        super().__init__(bins, spark.read.parquet(folder), y, False)

    @classmethod
    def of(cls, d: DataFrame, y: str, key: str, reps: int) -> "Replicates | None":
        found, n = cls.numbered(d), F.count(F.lit(1))
        if found is None:
            return None
        bins, x = found
        spark, folder, at = d.sparkSession, scratch_path(d.sparkSession, "replicates"), [*bins.columns, "__block"]
        x = x.select(key, F.col(y).alias("__y"), *[F.col(c).cast("int").alias(c) for c in at]).repartition(*at)
        x = x.withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(LANES))))
        x = x.withColumns({f"__d{j}": digest(key, boot_salt(F.col("__first") + j)) for j in range(LANES)})
        x = x.withColumns({f"__w{j}": poisson1_of_digest(F.col(f"__d{j}")).cast("double") for j in range(LANES)})
        sums = x.groupBy("__first", *at).agg((F.count("__y") == n).alias("__whole"), *[e for j in range(LANES) for e in (
            F.sum(f"__w{j}").alias(f"__w{j}"), F.sum(F.col("__y") * F.col(f"__w{j}")).alias(f"__s{j}"))])
        lanes = F.array(*[F.struct((F.col("__first") + j).alias("rep"), F.col(f"__w{j}").alias("w"), F.col(f"__s{j}").alias("s")) for j in range(LANES)])
        table = sums.select(*at, "__whole", F.explode(lanes).alias("__l")).where((F.col("__l.w") > 0) & (F.col("__l.rep") < reps)).select(
            *at, F.when(F.col("__whole"), F.try_divide("__l.s", "__l.w")).alias(y), F.col("__l.w").alias("__w"), F.col("__l.rep").alias("__rep"))
        table.repartition("__rep", "__block").write.partitionBy("__rep").parquet(folder)
        return cls(bins, folder, y, spark)

    def _part(self, without: int | None) -> tuple[DataFrame, int, float]:
        """Blocks of a replicate, each read by one fit only."""
        d = self.table.where(F.col("__rep") == without)
        return (d, *d.agg(F.count(F.lit(1)), F.sum("__w")).first())

    def refit(self, kind: str, params: dict, b: int):
        """A model of binned ``features``, of replicate ``b``."""
        return self._fit(kind, params, b).model


def boot_salt(b: Column) -> Column:
    return F.concat(F.lit("boot"), b.cast("string"))


def bootstrap_prediction_interval(kind: str, params: dict, train: DataFrame, test: DataFrame, key: str, y: str,
                                  reps: int, parallelism: int = 4) -> DataFrame:
    """Refit on Poisson-weighted training rows ``reps`` times, then score
    every model over one scan of the test rows, dealt to all cores: a row's
    predictions are an array, and its mean and 2.5/97.5 % percentiles come from that array.  Many
    training rows are put together to blocks; their models see bins only, so each
    combination of bins in the test rows is scored once.  Failed
    replicates are skipped; if all fail, the interval is prediction +- 1.96 *
    0.1 * sd(pred)."""
    blocks = Replicates.of(train, y, key, reps)

    def one(b):
        try:
            if blocks is not None:
                return blocks.refit(kind, params, b)
            w = train.withColumn("__w", poisson1_weight(hash_uniform(key, boot_salt(F.lit(b)))).cast("double"))
            return estimator(kind, params, y, weight="__w").fit(w.where(F.col("__w") > 0))
        except FIT_ERRORS as e:
            log.warning("replicate %d failed: %s", b, str(e)[:200])
            return None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        models = [m for m in pool.map(one, range(reps)) if m is not None]
    if not models:
        base = fit(kind, params, train, y).transform(test).select(key, y, "prediction")
        sd = base.agg(F.stddev_samp("prediction")).first()[0] or 0.0
        half = 1.96 * 0.1 * sd
        return base.select(key, y, F.col("prediction").alias("pred_mean"),
                           (F.col("prediction") - half).alias("pi_lower"),
                           (F.col("prediction") + half).alias("pi_upper"), F.lit(0).alias("n_reps"))
    if blocks is None:
        return _band(spread(test.select(key, y, "features")), models, [key, y])
    at = blocks.bins.columns
    rows = blocks.bins.number(test.select(key, y, "features")).drop("features")
    cells = spread(blocks.bins.assemble(rows.select(*at).distinct(), keep=True))
    return rows.join(_band(cells, models, at), at).select(key, y, "pred_mean", "pi_lower", "pi_upper", "n_reps")


def _band(rows: DataFrame, models: list, keep: list[str]) -> DataFrame:
    """Mean, 2.5/97.5 % percentiles and number of the models' predictions for each row."""
    cols = [f"__p{b}" for b in range(len(models))]
    for c, m in zip(cols, models):
        rows = m.setPredictionCol(c).transform(rows)
    rows = rows.select(*keep, F.array_sort(F.array(*cols)).alias("__all"))
    total = F.aggregate("__all", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*keep, (total / F.size("__all")).alias("pred_mean"), _percentile(F.col("__all"), 0.025).alias("pi_lower"),
                       _percentile(F.col("__all"), 0.975).alias("pi_upper"), F.size("__all").alias("n_reps"))
