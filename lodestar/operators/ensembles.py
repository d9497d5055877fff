"""Forests and boosted trees from sums (K7/K8 on many rows).

``trees.Blocks`` has Spark add the rows of equal bins up to weighted blocks.  A fit needs
nothing but the blocks' weights and means, so where their number is bounded (it is
counted) one task fits one ensemble, and trials, folds and replicates are tasks side by
side: boosting on Spark's own trees is several jobs a level, 200 rounds of them a fit.
The trees are Spark's: level by level, at each node the split of the
greatest fall in variance over a random subset of the features, with a least weight and a
least gain; a first boosted tree of weight one fits the target, the others, of weight ``stepSize``,
twice the residuals (the gradient of the squared error).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE = "tree int, feature array<int>, cut array<int>, child array<int>, value array<double>, gain array<double>"
KNOWN = {"maxIter", "stepSize", "maxDepth", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode", "minInfoGain",
         "minWeightFractionPerNode", "numTrees", "bootstrap"}
SUMS = 1 << 22          # numbers in a block of sums


@dataclass(frozen=True)
class Tree:
    """Node i sends bins above ``cut[i]`` of entry ``feature[i]`` to node ``child[i] + 1``,
    the others to ``child[i]``; a leaf sends all to itself."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    gain: np.ndarray                 # fall in variance times weight; 0 at a leaf

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, row, flat = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1], x.ravel()
        while True:
            to = self.child[at] + (flat[row + self.feature[at]] > self.cut[at])
            if np.array_equal(to, at):
                return self.value[at]
            at = to


@dataclass(frozen=True)
class Settings:
    """What an estimator's parameters say, as numbers."""
    boosted: bool
    trees: int
    step: float
    depth: int
    share: float
    replace: bool
    features: int
    least_share: float
    least_gain: float
    seed: int

    @classmethod
    def of(cls, e, width: int) -> "Settings":
        boosted = isinstance(e, GBTRegressor)
        trees = e.getMaxIter() if boosted else e.getNumTrees()
        return cls(boosted, trees, e.getStepSize() if boosted else 1.0, e.getMaxDepth(), e.getSubsamplingRate(), not boosted and e.getBootstrap(),
                   features_a_node(e.getFeatureSubsetStrategy(), width, boosted or trees == 1), e.getMinWeightFractionPerNode(), e.getMinInfoGain(), e.getSeed())

    def check(self) -> None:
        if not (self.trees >= 1 and 0 <= self.depth <= 30 and 0 < self.share <= 1 and 0 < self.step <= 1
                and self.features >= 1 and 0 <= self.least_share < 0.5 and self.least_gain >= 0):
            raise ValueError(f"no such ensemble: {self}")


def features_a_node(strategy: str, width: int, one_tree: bool) -> int:
    """Number of features that ``featureSubsetStrategy`` names; 0 if it names none."""
    named = {"auto": width if one_tree else math.ceil(width / 3), "all": width, "onethird": math.ceil(width / 3),
             "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width)))}
    if strategy in named:
        return named[strategy]
    try:
        n = float(strategy)
    except ValueError:
        return 0
    if strategy.isdigit():
        return min(width, int(n))
    return math.ceil(n * width) if 0 < n <= 1 else 0


def grow(x: np.ndarray, w: np.ndarray, wy: np.ndarray, s: Settings, least: float, rng) -> tuple[Tree, np.ndarray]:
    """One tree of the cells ``x`` (a row of bins each) with weights ``w`` and weighted
    targets ``wy``, and the leaf of each cell."""
    n, p = x.shape
    bins = int(x.max(initial=0)) + 1
    keys, column = x + np.arange(p) * bins, np.arange(n) * p
    node, first, nodes, parts = np.zeros(n, np.int64), 0, 1, []
    for level in range(s.depth + 1):
        cells = np.flatnonzero(node >= first)
        at = node[cells] - first
        weight, total = np.bincount(at, w[cells], nodes), np.bincount(at, wy[cells], nodes)
        value = np.divide(total, weight, out=np.zeros(nodes), where=weight > 0)
        best, gain = np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
        drawn = w[cells] > 0
        step = max(1, SUMS // (p * bins))
        for lo in range(0, nodes if level < s.depth and bins > 1 else 0, step):
            k = min(step, nodes - lo)
            some = drawn if k == nodes else drawn & (at >= lo) & (at < lo + k)
            c = cells[some]
            key = (keys[c] + ((at[some] - lo) * (p * bins))[:, None]).ravel()
            left_w, left_y = (np.bincount(key, np.repeat(v[c], p), k * p * bins).reshape(k, p, bins).cumsum(2)[:, :, :-1] for v in (w, wy))
            all_w, all_y = weight[lo:lo + k, None, None], total[lo:lo + k, None, None]
            right_w, right_y = all_w - left_w, all_y - left_y
            ok = (left_w >= least) & (right_w >= least) & (left_w > 0) & (right_w > 0)
            if s.features < p:
                ok &= (rng.random((k, p)).argsort(1).argsort(1) < s.features)[:, :, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                g = (left_y * left_y / left_w + right_y * right_y / right_w - all_y * all_y / all_w) / all_w
            g = np.where(ok, g, -np.inf).reshape(k, -1)
            best[lo:lo + k] = g.argmax(1)
            gain[lo:lo + k] = g[np.arange(k), best[lo:lo + k]]
        split = (gain > 0) & (gain >= s.least_gain)
        ids = np.arange(first, first + nodes)
        child = np.where(split, first + nodes + 2 * (np.cumsum(split) - 1), ids)
        feature, cut = (np.where(split, v, o) for v, o in ((best // max(1, bins - 1), 0), (best % max(1, bins - 1), bins)))
        parts.append((feature, cut, child, value, np.where(split, gain * weight, 0.0)))
        go = split[at]
        c, a = cells[go], at[go]
        node[c] = child[a] + (x.ravel()[column[c] + feature[a]] > cut[a])
        first, nodes = first + nodes, 2 * int(split.sum())
        if not nodes:
            break
    return Tree(*map(np.concatenate, zip(*parts))), node


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings) -> list[Tree]:
    """The trees of an ensemble of blocks (bins ``x``, mean ``y``, weight ``w``).  A draw is
    of blocks; the blocks of a cell of bins are added up for the tree."""
    s.check()
    cells, of = np.unique(x, axis=0, return_inverse=True)
    of, centre, least = of.reshape(-1), np.average(y, weights=w), s.least_share * w.sum()
    wy, score, out = w * (y - centre), np.zeros(len(cells)), []
    for t in range(s.trees):
        rng = np.random.default_rng([s.seed, t])
        if s.replace:
            drawn = rng.poisson(s.share, len(w))
        else:
            drawn = rng.random(len(w)) < s.share if s.share < 1 else 1.0
        sw, sy = np.bincount(of, w * drawn), np.bincount(of, wy * drawn)
        tree, leaf = grow(cells, sw, 2 * (sy - sw * score) if s.boosted and t else sy, s, least, rng)
        if s.boosted:
            score += (s.step if t else 1.0) * tree.value[leaf]
        if not (s.boosted and t):
            tree = Tree(tree.feature, tree.cut, tree.child, tree.value + centre, tree.gain)
        out.append(tree)
    return out


def _fitting(width: int, s: Settings):
    def run(batches):
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        if not parts:
            raise ValueError("no rows to fit")
        rows = np.concatenate(parts)
        if np.isnan(rows).any():
            raise ValueError("labels must not be null or NaN")
        rows = rows[np.lexsort(rows.T)]                    # the draws do not depend on the order of arrival
        x, y, w = rows[:, :width].astype(np.int64), rows[:, -2], rows[:, -1]
        for t, tree in enumerate(fit_trees(x, y, w, s)):
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t], pa.int32()), **{c: pa.array([getattr(tree, c).tolist()], pa.list_(pa.int32())) for c in ("feature", "cut", "child")},
                **{c: pa.array([getattr(tree, c).tolist()], pa.list_(pa.float64())) for c in ("value", "gain")}})
    return run


def _codes(entries: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bins and the number of each row's."""
    x = np.concatenate(entries.to_list()).reshape(len(entries), width) if len(entries) else np.zeros((0, width))
    distinct, of = np.unique(x.astype(np.int64), axis=0, return_inverse=True)
    return distinct, of.reshape(-1)


class Ensemble:
    """A fitted ensemble of binned ``features``; like Spark's models where it is used."""

    def __init__(self, trees: list[Tree], s: Settings, width: int, y: str, weight: str, column: str = "prediction"):
        self.trees, self.settings, self.width, self.y, self.weight, self.column = trees, s, width, y, weight, column
        n = len(trees)
        self.weights = [1.0] + [s.step] * (n - 1) if s.boosted else [1.0 / n] * n

    @classmethod
    def fit(cls, e, blocks: DataFrame, bins: list[str], block: str, y: str, weight: str) -> "Ensemble":
        """Fits ``blocks`` (bins, number, mean, weight) in one task, by the parameters of the estimator ``e``."""
        s = Settings.of(e, len(bins))
        d = blocks.select(*bins, F.col(block).cast("double"), y, weight).coalesce(1)
        rows = d.mapInArrow(_fitting(len(bins), s), TREE).collect()
        ints, doubles = (lambda v: np.array(v, np.int64)), (lambda v: np.array(v, np.float64))
        trees = [Tree(ints(r.feature), ints(r.cut), ints(r.child), doubles(r.value), doubles(r.gain)) for r in sorted(rows, key=lambda r: r.tree)]
        return cls(trees, s, len(bins), y, weight)

    def setPredictionCol(self, column: str) -> "Ensemble":
        return Ensemble(self.trees, self.settings, self.width, self.y, self.weight, column)

    def transform(self, df: DataFrame) -> DataFrame:
        trees, weights, width = self.trees, self.weights, self.width

        @F.pandas_udf("double")
        def score(entries: pd.Series) -> pd.Series:
            x, of = _codes(entries, width)
            return pd.Series(sum((w * t.predict(x) for t, w in zip(trees, weights)), np.zeros(len(x)))[of])
        return df.withColumn(self.column, score(vector_to_array("features")))

    def evaluateEachIteration(self, df: DataFrame, loss: str) -> list[float]:
        """Weighted mean loss after each tree."""
        trees, weights, width, of_error = self.trees, self.weights, self.width, {"squared": np.square, "absolute": np.abs}[loss]

        def run(frames):
            sums, total = np.zeros(len(trees)), 0.0
            for f in frames:
                (x, of), y, w = _codes(f["x"], width), f["y"].to_numpy(), f["w"].to_numpy()
                score, total = np.zeros(len(x)), total + w.sum()
                for i, (t, by) in enumerate(zip(trees, weights)):
                    score += by * t.predict(x)
                    sums[i] += (of_error(y - score[of]) * w).sum()
            yield pd.DataFrame({"i": np.arange(len(trees)), "loss": sums, "w": total})
        d = df.select(vector_to_array("features").alias("x"), F.col(self.y).cast("double").alias("y"), F.col(self.weight).cast("double").alias("w"))
        rows = d.mapInPandas(run, "i int, loss double, w double").groupBy("i").agg((F.sum("loss") / F.sum("w")).alias("loss")).collect()
        return [r.loss for r in sorted(rows, key=lambda r: r.i)]

    @property
    def featureImportances(self):
        """Falls in variance by feature, of one sum; in a forest each tree counts the same."""
        total = np.zeros(self.width)
        for t in self.trees:
            own = np.bincount(t.feature, t.gain, self.width)
            total += own if self.settings.boosted or not own.sum() else own / own.sum()
        return Vectors.dense(total / total.sum() if total.sum() else total)
