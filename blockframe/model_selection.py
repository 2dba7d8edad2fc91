"""Cross-validated searches over parameters, and simulations over parameter grids.

Candidates and folds run as concurrent Spark jobs from a few driver threads; only scores come back.
"""

from __future__ import annotations

import numbers
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np

from blockframe.estimator import clone
from blockframe.operators.ordering import KFold, infer_cv, train_test_split

__all__ = ["GridSearchCV", "KFold", "RandomizedSearchCV", "SimulationGridSearch", "infer_cv", "parameter_grid", "parameter_sample", "train_test_split"]
THREADS = 4


def parameter_grid(grid) -> list[dict]:
    """Every combination of a grid (or of each of a list of grids), names in order."""
    out = []
    for g in [grid] if isinstance(grid, dict) else list(grid):
        for name, values in g.items():
            if isinstance(values, (str, numbers.Number)) or not hasattr(values, "__iter__") or len(list(values)) == 0:
                raise ValueError(f"parameter {name!r} needs a non-empty list of values")
        names = sorted(g)
        out += [dict(zip(names, v, strict=True)) for v in product(*[list(g[n]) for n in names])]
    return out


def parameter_sample(distributions, n_iter: int, random_state=None) -> list[dict]:
    """``n_iter`` draws: from lists, or from anything with ``rvs``. Grids of lists alone are drawn without repeats."""
    rng = np.random.RandomState(random_state)
    options = [distributions] if isinstance(distributions, dict) else list(distributions)
    if all(not hasattr(v, "rvs") for d in options for v in d.values()):
        grid = [p for d in options for p in parameter_grid(d)]
        return [grid[i] for i in rng.permutation(len(grid))[:n_iter]]
    out = []
    for _ in range(n_iter):
        d = options[rng.randint(len(options))]
        out.append({k: v.rvs(random_state=rng) if hasattr(v, "rvs") else list(v)[rng.randint(len(list(v)))] for k, v in sorted(d.items())})
    return out


def rank_min(values, largest_first: bool = True) -> np.ndarray:
    """Competition ranks from 1: equal values share the smallest."""
    v = np.asarray(values, float) * (-1 if largest_first else 1)
    return np.array([1 + int((v < x).sum()) for x in v], dtype=np.int32)


def check_scorer(estimator, scoring) -> dict[str, Callable]:
    """Named scorers: None is the estimator's own score."""
    if scoring is None:
        if not hasattr(estimator, "score"):
            raise TypeError(f"{type(estimator).__name__} has no score method")
        return {"score": lambda e, x, y: e.score(x, y)}
    if callable(scoring):
        return {"score": scoring}
    if isinstance(scoring, dict) and scoring and all(map(callable, scoring.values())):
        return dict(scoring)
    raise ValueError("scoring must be None, a callable or a dict of callables")


class _Search:
    def __init__(self, estimator, scoring=None, cv=None, refit=True, sort: str = "max"):
        if sort not in ("max", "min"):
            raise ValueError("sort must be max or min")
        self.estimator, self.scoring, self.cv, self.refit, self.sort = estimator, scoring, cv, refit, sort

    def fit(self, x, y=None):
        scorers = check_scorer(self.estimator, self.scoring)
        multiple = isinstance(self.scoring, dict)
        if multiple and self.refit is not False and not callable(self.refit) and self.refit not in scorers:
            raise ValueError("with several scorers refit must name one of them, be callable, or be False")
        candidates, cv = self._candidates(), infer_cv(self.cv)
        folds = list(cv.split(x, y))

        def run(job: tuple[dict, tuple]) -> dict[str, float]:
            params, ((tx, ty), (vx, vy)) = job
            model = clone(self.estimator).set_params(**params)
            model.fit(tx, ty)
            return {k: float(f(model, vx, vy)) for k, f in scorers.items()}

        jobs = [(p, f) for p in candidates for f in folds]
        with ThreadPoolExecutor(THREADS) as pool:
            scores = list(pool.map(run, jobs))
        self.n_splits_, self.scorer_ = len(folds), scorers if multiple else scorers["score"]
        self.cv_results_ = self._results(candidates, scores, len(folds), list(scorers))
        metric = self.refit if multiple and isinstance(self.refit, str) else ("score" if not multiple else None)
        if callable(self.refit):
            self.best_index_ = int(self.refit(self.cv_results_))
        elif metric:
            self.best_index_ = int(self.cv_results_[f"rank_test_{metric}"].argmin())
        if hasattr(self, "best_index_"):
            self.best_params_ = candidates[self.best_index_]
            if metric:
                self.best_score_ = self.cv_results_[f"mean_test_{metric}"][self.best_index_]
            if self.refit is not False:
                self.best_estimator_ = clone(self.estimator).set_params(**self.best_params_)
                self.best_estimator_.fit(x, y)
        return self

    def _results(self, candidates: list[dict], scores: list[dict], folds: int, names: list[str]) -> dict:
        out: dict = {f"param_{k}": np.ma.masked_all(len(candidates), object) for c in candidates for k in c}
        for i, c in enumerate(candidates):
            for k, v in c.items():
                out[f"param_{k}"][i] = v
        out["params"] = candidates
        for s in names:
            table = np.array([r[s] for r in scores]).reshape(len(candidates), folds)
            for f in range(folds):
                out[f"split{f}_test_{s}"] = table[:, f]
            out[f"mean_test_{s}"], out[f"std_test_{s}"] = table.mean(axis=1), table.std(axis=1)
            out[f"rank_test_{s}"] = rank_min(out[f"mean_test_{s}"], self.sort == "max")
        return out

    def predict(self, x):
        return self.best_estimator_.predict(x)


class GridSearchCV(_Search):
    """Every combination of ``param_grid``; equal scores share the better rank and the first of them is best."""

    def __init__(self, estimator, param_grid, sort: str = "max", scoring=None, cv=None, refit=True):
        super().__init__(estimator, scoring, cv, refit, sort)
        self.param_grid = param_grid
        parameter_grid(param_grid)

    def _candidates(self) -> list[dict]:
        return parameter_grid(self.param_grid)


class RandomizedSearchCV(_Search):
    """``n_iter`` draws from ``param_distributions``."""

    def __init__(self, estimator, param_distributions, n_iter: int = 10, scoring=None, cv=None, refit=True, random_state=None, sort: str = "max"):
        super().__init__(estimator, scoring, cv, refit, sort)
        self.param_distributions, self.n_iter, self.random_state = param_distributions, n_iter, random_state

    def _candidates(self) -> list[dict]:
        return parameter_sample(self.param_distributions, self.n_iter, self.random_state)


class SimulationGridSearch:
    """A function of parameters evaluated ``sim_number`` times for every combination; mean, deviation and rank of its results."""

    def __init__(self, estimator: Callable, param_grid, sim_number: int = 1, order: str = "max"):
        if not callable(estimator):
            raise NotImplementedError("a callable is needed")
        if order not in ("max", "min"):
            raise ValueError("order must be max or min")
        self.estimator, self.param_grid, self.sim_number, self.order = estimator, param_grid, sim_number, order

    def fit(self, x=None, y=None) -> SimulationGridSearch:
        """Runs are tasks of one Spark job unless data are given, when they run on the driver with those data."""
        candidates = parameter_grid(self.param_grid)
        jobs = [p for p in candidates for _ in range(self.sim_number)]
        if x is None:
            from blockframe.dsarray import session

            function = self.estimator
            results = session().sparkContext.parallelize(jobs, max(1, len(jobs))).map(lambda p: float(function(**p))).collect()
        else:
            with ThreadPoolExecutor(THREADS) as pool:
                results = list(pool.map(lambda p: float(self.estimator(x, y, **p) if y is not None else self.estimator(x, **p)), jobs))
        table = np.array(results).reshape(len(candidates), self.sim_number)
        out: dict = {"params": candidates, "mean_simulation": table.mean(axis=1), "std_simulation": table.std(axis=1)}
        out |= {f"simulation{k}": table[:, k] for k in range(self.sim_number)}
        out["rank_simulation"] = rank_min(out["mean_simulation"], self.order == "max")
        self.cv_results_ = self.simulation_results_ = out
        self.best_index_ = int(out["rank_simulation"].argmin())
        self.best_params_, self.best_score_ = candidates[self.best_index_], out["mean_simulation"][self.best_index_]
        return self
