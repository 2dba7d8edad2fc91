"""Decision trees and forests: histogram trees of Spark ML, or trees of candidate splits.

``mmap=False`` grows trees level by level from candidate splits of every node (:mod:`blockframe.candidate_trees`): ``split_computation`` tells where
candidates come from, ``n_split_points`` how many there are, ``range_min`` and ``range_max`` bound the uniform ones, and a split for classes leaves at
least four rows on either side. Their depth is unbounded unless ``max_depth`` says otherwise.

``mmap=True``, the default, uses the histogram trees of Spark ML, of depth 30 at most (deeper ones are refused). There ``split_computation``, ``range_min`` and
``range_max`` have no effect, nor has ``n_split_points`` up to 31, since no feature has fewer than 32 bins; single trees try all features at a split.
Parameters that steered task nesting or memory (``distr_depth``, ``sklearn_max``, ``nested``, ``sync_after_fit``) have no effect in either.
"""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.ml import classification, regression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe import candidate_trees
from blockframe.dsarray import DsArray
from blockframe.classification.knn import accuracy
from blockframe.estimator import Estimator
from blockframe.plans.index import cumulate
from blockframe.regression import r2_score

#: The deepest tree and the most bins of the engine.
DEEPEST, MOST_BINS = 30, 4096
MOST_CLASSES = 1000


def resolve_try_features(try_features, n_features: int) -> int:
    """Number of features tried at a split: None all, "sqrt", "third", a number, or a share below 1."""
    if try_features is None:
        return n_features
    if try_features == "sqrt":
        return max(1, int(math.sqrt(n_features)))
    if try_features == "third":
        return max(1, n_features // 3)
    if isinstance(try_features, str):
        raise ValueError(f"unknown try_features {try_features!r}")
    return int(try_features) if try_features >= 1 else max(1, int(try_features * n_features))


def resolve_split_points(n_split_points, n: int) -> int:
    """Candidate thresholds of a feature: "auto" ln n, "sqrt", a number, or a share below 1."""
    if n_split_points == "auto":
        return max(1, int(math.log(max(n, 2))))
    if n_split_points == "sqrt":
        return max(1, int(math.sqrt(n)))
    if isinstance(n_split_points, str):
        raise ValueError(f"unknown n_split_points {n_split_points!r}")
    return max(1, int(n_split_points) if n_split_points >= 1 else int(n_split_points * n))


class _Trees(Estimator):
    transient = ("_model",)
    forest, classifier = True, True

    def __init__(
        self, n_estimators: int = 10, try_features="sqrt", max_depth: float = np.inf, distr_depth="auto", sklearn_max: float = 1e8, hard_vote: bool = False,
        random_state: int | None = None, n_classes: int | None = None, range_max=None, range_min=None, bootstrap: bool = True,
        n_split_points="auto", split_computation: str = "raw", sync_after_fit: bool = True, mmap: bool = True, nested: bool = False,
    ):
        if split_computation not in ("raw", "gaussian_approximation", "uniform_approximation"):
            raise ValueError(f"unknown split_computation {split_computation!r}")
        if distr_depth != "auto" and (not isinstance(distr_depth, (int, np.integer)) or distr_depth < 0):
            raise ValueError("distr_depth must be 'auto' or a number")
        self.n_estimators, self.try_features, self.max_depth, self.distr_depth, self.sklearn_max = n_estimators, try_features, max_depth, distr_depth, sklearn_max
        self.hard_vote, self.random_state, self.n_classes, self.range_max, self.range_min = hard_vote, random_state, n_classes, range_max, range_min
        self.bootstrap, self.n_split_points, self.split_computation, self.sync_after_fit = bootstrap, n_split_points, split_computation, sync_after_fit
        self.mmap, self.nested = mmap, nested
        if mmap and np.isfinite(max_depth) and max_depth > DEEPEST:
            raise ValueError(f"trees deeper than {DEEPEST} need mmap=False")
        self.classes = self.forest_ = None
        self._model = None

    def _engine(self):
        kind = ("RandomForest" if self.forest else "DecisionTree") + ("Classifier" if self.classifier else "Regressor")
        return getattr(classification if self.classifier else regression, kind)

    def fit(self, x: DsArray, y: DsArray):
        n, m = x.shape
        rows = x.to_dense().df.join(y.to_dense().df.select("row_idx", F.get("features", F.lit(0)).alias("y")), "row_idx")
        label = F.col("y")
        if self.classifier:
            found = rows.select("y").distinct().limit(MOST_CLASSES + 1).collect()
            if len(found) > MOST_CLASSES:
                raise ValueError(f"more than {MOST_CLASSES} classes")
            self.classes = sorted(r["y"] for r in found)
            label = F.array_position(F.lit([float(c) for c in self.classes]), F.col("y")).cast("double") - 1
        if not self.mmap:
            points, tried = resolve_split_points(self.n_split_points, n), resolve_try_features(self.try_features, m)
            number, seed = (int(self.n_estimators), 0 if self.random_state is None else int(self.random_state)) if self.forest else (1, int(self.random_state or 0))
            data = rows.select("row_idx", "features", label.alias("y"))
            classes, bags = len(self.classes) if self.classifier else 0, bool(self.bootstrap) and self.forest
            self.forest_ = candidate_trees.grow(data, m, classes, number, self.max_depth, tried, points, self.split_computation, self.range_min, self.range_max, bags, seed)
            return self
        data = rows.select(array_to_vector("features").alias("features"), label.alias("label"))
        bins = min(MOST_BINS, max(32, resolve_split_points(self.n_split_points, n) + 1))
        engine = self._engine()(maxDepth=int(min(self.max_depth, DEEPEST)), maxBins=bins, seed=0 if self.random_state is None else int(self.random_state))
        if self.forest:
            tried = resolve_try_features(self.try_features, m)
            engine = engine.setNumTrees(int(self.n_estimators)).setBootstrap(bool(self.bootstrap)).setFeatureSubsetStrategy("all" if tried >= m else str(tried))
        self._model = engine.fit(data)
        return self

    def _scored(self, x: DsArray) -> DataFrame:
        self._check("_model")
        return self._model.transform(x.to_dense().df.select("row_idx", array_to_vector("features").alias("features")))

    def _class(self, index) -> F.Column:
        return F.array(F.element_at(F.lit([float(c) for c in self.classes]), index.cast("int") + 1))

    def _shares(self, x: DsArray, hard: bool = False) -> DsArray:
        """Class shares, or the value, by the trees of candidate splits."""
        width = len(self.classes) if self.classifier else 0
        return DsArray(candidate_trees.predict(x.to_dense().df, self.forest_, x.shape[1], hard, width), (x.shape[0], max(1, width)))

    def predict(self, x: DsArray) -> DsArray:
        if self.forest_ is not None:
            found = self._shares(x, self.hard_vote)
            if not self.classifier:
                return found
            label = self._class(F.array_position("features", F.array_max("features")) - 1)
            return DsArray(found.df.select("row_idx", label.alias("features")), (x.shape[0], 1))
        scored = self._scored(x)
        if not self.classifier:
            out = F.array("prediction")
        elif self.forest and self.hard_vote:
            return self._hard(x)
        else:
            out = self._class(F.col("prediction"))
        return DsArray(scored.select("row_idx", out.alias("features")), (x.shape[0], 1))

    def _hard(self, x: DsArray) -> DsArray:
        """The class most trees vote for, the lowest among equals."""
        rows = x.to_dense().df.select("row_idx", array_to_vector("features").alias("features"))
        for k, tree in enumerate(self._model.trees):  # one pass: each tree adds a column
            rows = tree.setFeaturesCol("features").setPredictionCol(f"p{k}").setRawPredictionCol("").setProbabilityCol("").transform(rows)
        ballots = F.array(*[F.col(f"p{k}") for k in range(len(self._model.trees))])
        counts = F.transform(F.lit([float(c) for c in range(len(self.classes))]), lambda c: F.size(F.filter(ballots, lambda b: b == c)))
        return DsArray(rows.select("row_idx", self._class(F.array_position(counts, F.array_max(counts)) - 1).alias("features")), (x.shape[0], 1))

    def predict_proba(self, x: DsArray) -> DsArray:
        if not self.classifier:
            raise AttributeError("a regressor has no class probabilities")
        if self.forest_ is not None:
            return self._shares(x)
        return DsArray(self._scored(x).select("row_idx", vector_to_array("probability").alias("features")), (x.shape[0], len(self.classes)))

    def score(self, x: DsArray, y: DsArray) -> float:
        """Accuracy of a classifier, R squared of a regressor."""
        return (accuracy if self.classifier else r2_score)(self.predict(x), y)

    def save_model(self, path: str, overwrite: bool = True, save_format: str = "json") -> None:
        """The trees go with the model in ``path`` + ``.trees``; those of candidate splits are within it, and need pickle."""
        if self.forest_ is not None:
            if save_format != "pickle":
                raise ValueError("trees of candidate splits are saved as pickle")
            return super().save_model(path, overwrite, save_format)
        self._check("_model")
        if os.path.exists(path) and not overwrite:
            return
        super().save_model(path, overwrite, save_format)
        self._model.write().overwrite().save(f"{path}.trees")

    @classmethod
    def load_model(cls, path: str, load_format: str = "json"):
        out = super().load_model(path, load_format)
        if out.forest_ is not None:
            return out
        kind = ("RandomForest" if cls.forest else "DecisionTree") + ("Classification" if cls.classifier else "Regression") + "Model"
        out._model = getattr(classification if cls.classifier else regression, kind).load(f"{path}.trees")
        return out


class RandomForestClassifier(_Trees):
    """Soft vote (largest mean probability) or ``hard_vote`` (most trees)."""


class RandomForestRegressor(_Trees):
    """Mean of the trees."""

    classifier = False


class DecisionTreeClassifier(_Trees):
    forest = False


class DecisionTreeRegressor(_Trees):
    forest, classifier = False, False


def best_split(df: DataFrame, value: str, label: str, classes: bool = True) -> DataFrame:
    """(threshold, score): the exact best binary split of one feature, for class labels or for numbers.

    Running statistics over distinct values, so equal values stay together; the score is the negative sum over both sides of
    squared class counts (or squared sums) over rows, and the largest of equally good thresholds is taken.
    """
    if classes:
        labels = [r[0] for r in df.select(label).distinct().limit(MOST_CLASSES + 1).collect()]
        if len(labels) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        sums = [F.count(F.when(F.col(label).eqNullSafe(F.lit(c)), 1)).alias(f"s{k}") for k, c in enumerate(labels)]
    else:
        labels, sums = [None], [F.sum(F.col(label).cast("double")).alias("s0")]
    cells = df.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"), *sums)
    names = [f"s{k}" for k in range(len(labels))]
    running, totals = cumulate(cells, "x", ["n", *names])
    left, right = (sum((f(c) ** 2 for c in names), F.lit(0.0)) for f in (lambda c: F.col(f"cum_{c}"), lambda c: F.lit(totals[c]) - F.col(f"cum_{c}")))
    score = -(left / F.col("cum_n") + right / F.when(F.lit(totals["n"]) > F.col("cum_n"), F.lit(totals["n"]) - F.col("cum_n")))
    scored = running.filter(F.col("next").isNotNull()).select(((F.col("x") + F.col("next")) / 2).alias("threshold"), score.alias("score"))
    return scored.orderBy("score", F.desc("threshold")).limit(1)
