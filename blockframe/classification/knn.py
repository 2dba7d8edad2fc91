"""Nearest-neighbour classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.estimator import Estimator
from blockframe.operators.proximity import top_k


def accuracy(predicted: DsArray, y: DsArray) -> float:
    """Share of rows whose label is predicted."""
    a, b = predicted.to_dense().df, y.to_dense().df.select("row_idx", F.col("features").alias("__y"))
    same = F.get("features", F.lit(0)) == F.get("__y", F.lit(0))
    return float(a.join(b, "row_idx").agg(F.avg(same.cast("double"))).first()[0] or 0.0)


class KNeighborsClassifier(Estimator):
    """``weights``: "uniform", "distance" (1 / (d + eps of a double)), or a function of an array of distances. Equal votes go to the
    class of the nearer neighbour."""

    transient = ("_x", "_y")

    def __init__(self, n_neighbors: int = 5, weights: str | Callable = "uniform", random_state: int | None = None):
        self.n_neighbors, self.weights, self.random_state = n_neighbors, weights, random_state
        self._x = self._y = None

    def fit(self, x: DsArray, y: DsArray) -> KNeighborsClassifier:
        self._x, self._y = x.to_dense(), y.to_dense()
        return self

    def votes(self, q: DsArray) -> DataFrame:
        """(q, class, weight, first): summed weight of every class among the neighbours of every query."""
        self._check("_x", "_y")
        near = top_k(self._x.df, q.to_dense().df, self.n_neighbors, q.shape[1])
        labels = self._y.df.select(F.col("row_idx").alias("idx"), F.get("features", F.lit(0)).alias("class"))
        d = F.sqrt("d2")
        if callable(self.weights):
            own = self.weights

            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for p in parts:
                    yield p.assign(w=np.asarray(own(np.sqrt(p["d2"].to_numpy())), float) if len(p) else [])

            near, weight = near.mapInPandas(run, "q bigint, idx bigint, d2 double, rank int, w double"), F.col("w")
        elif self.weights == "uniform":
            weight = F.lit(1.0)
        else:
            weight = 1.0 / (d + F.lit(float(np.finfo(float).eps)))
        return near.join(labels, "idx").groupBy("q", "class").agg(F.sum(weight).alias("weight"), F.min("rank").alias("first"))

    def predict(self, q: DsArray) -> DsArray:
        """Labels, n_queries x 1."""
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("weight"), "first"))
        rows = self.votes(q).withColumn("__r", best).filter("__r = 1")
        return DsArray(rows.select(F.col("q").alias("row_idx"), F.array(F.col("class").cast("double")).alias("features")), (q.shape[0], 1))

    def score(self, q: DsArray, y: DsArray) -> float:
        return accuracy(self.predict(q), y)

    def save_model(self, path: str, overwrite: bool = True, save_format: str = "json") -> None:
        """Training data goes with the model as Parquet, in ``path`` + ``.x`` and ``.y``."""
        self._check("_x", "_y")
        super().save_model(path, overwrite, save_format)
        for name, a in (("x", self._x), ("y", self._y)):
            a.df.write.mode("overwrite").parquet(f"{path}.{name}")

    @classmethod
    def load_model(cls, path: str, load_format: str = "json"):
        from blockframe.dsarray import from_rows, session

        out = super().load_model(path, load_format)
        out._x, out._y = (from_rows(session().read.parquet(f"{path}.{n}"), "row_idx", "features") for n in "xy")
        return out
