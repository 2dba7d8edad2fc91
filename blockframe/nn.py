"""Neural networks trained by local steps and parameter averaging.

Every partition is a worker: it starts from the shared weights, takes optimizer steps over its rows, and sends its weights back; the
driver averages them. ``every n epochs`` variants average after several local epochs. A commutative pairwise average has no place
in a synchronous plan, so the asynchronous variants take the same averaging step (as documented deviation) and differ in nothing else.
Networks here are NumPy multilayer perceptrons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from blockframe.dsarray import DsArray
from blockframe.operators.ordering import hash_order
from blockframe.plans.index import stack, sum_states
from blockframe.plans.runtime import durable

#: Default rates and decays of the optimizers.
DEFAULTS = {
    "sgd": {"lr": 0.01, "momentum": 0.0},
    "adam": {"lr": 0.001, "beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-8},
    "adamax": {"lr": 0.002, "beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-8},
    "nadam": {"lr": 0.002, "beta_1": 0.9, "beta_2": 0.999, "epsilon": 1e-8},
    "rmsprop": {"lr": 0.01, "rho": 0.9, "epsilon": 1e-8},
    "adagrad": {"lr": 0.01, "epsilon": 1e-8},
    "adadelta": {"lr": 1.0, "rho": 0.95, "epsilon": 1e-6},
}


class Optimizer:
    """One of seven update rules over a flat weight vector."""

    def __init__(self, name: str, **parameters):
        if name not in DEFAULTS:
            raise ValueError(f"unknown optimizer {name!r}")
        self.name, self.p, self.t, self.m, self.v = name, DEFAULTS[name] | parameters, 0, 0.0, 0.0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        p, self.t = self.p, self.t + 1
        if self.name == "sgd":
            self.m = p["momentum"] * self.m + g
            return w - p["lr"] * self.m
        if self.name == "adagrad":
            self.v = self.v + g * g
            return w - p["lr"] * g / (np.sqrt(self.v) + p["epsilon"])
        if self.name == "rmsprop":
            self.v = p["rho"] * self.v + (1 - p["rho"]) * g * g
            return w - p["lr"] * g / (np.sqrt(self.v) + p["epsilon"])
        if self.name == "adadelta":
            self.v = p["rho"] * self.v + (1 - p["rho"]) * g * g
            d = np.sqrt((self.m + p["epsilon"]) / (self.v + p["epsilon"])) * g
            self.m = p["rho"] * self.m + (1 - p["rho"]) * d * d
            return w - p["lr"] * d
        b1, b2 = p["beta_1"], p["beta_2"]
        self.m = b1 * self.m + (1 - b1) * g
        if self.name == "adamax":
            self.v = np.maximum(b2 * self.v, np.abs(g))
            return w - p["lr"] / (1 - b1**self.t) * self.m / (self.v + p["epsilon"])
        self.v = b2 * self.v + (1 - b2) * g * g
        m = self.m / (1 - b1**self.t)
        if self.name == "nadam":
            m = b1 * m + (1 - b1) * g / (1 - b1**self.t)
        return w - p["lr"] * m / (np.sqrt(self.v / (1 - b2**self.t)) + p["epsilon"])


class Mlp:
    """A perceptron of the given layer sizes: rectified inner layers, softmax (cross entropy) or linear (squared error) output."""

    def __init__(self, sizes: list[int], loss: str = "cross_entropy", random_state: int = 0):
        if loss not in ("cross_entropy", "mse"):
            raise ValueError("loss must be cross_entropy or mse")
        self.sizes, self.loss, rng = list(sizes), loss, np.random.default_rng(random_state)
        self.weights = np.concatenate([np.concatenate([(rng.standard_normal((a, b)) * np.sqrt(2 / a)).ravel(), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        values, layers = [x], self.layers(w)
        for k, (m, b) in enumerate(layers):
            z = values[-1] @ m + b
            if k < len(layers) - 1:
                z = np.maximum(z, 0)
            elif self.loss == "cross_entropy":
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            values.append(z)
        return values

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        values, layers = self.forward(w, x), self.layers(w)
        delta, out = (values[-1] - y) / len(x) * (1 if self.loss == "cross_entropy" else 2), []
        for k in range(len(layers) - 1, -1, -1):
            out[:0] = [(values[k].T @ delta).ravel(), delta.sum(axis=0)]
            delta = (delta @ layers[k][0].T) * (values[k] > 0)
        return np.concatenate(out)


class DistributedTraining:
    """``build`` takes a network, an optimizer name, its parameters and batch settings; each ``fit_*`` returns averaged weights."""

    def __init__(self, num_workers: int = 10):
        if num_workers < 1:
            raise ValueError("num_workers must be positive")
        self.num_workers, self.net = num_workers, None

    def build(self, net: Mlp, optimizer: str = "sgd", loss: str | None = None, optimizer_parameters: dict | None = None, num_gpu: int = 0, num_nodes: int = 1) -> DistributedTraining:
        if loss is not None and loss != net.loss:
            raise ValueError("the loss is that of the network")
        Optimizer(optimizer, **(optimizer_parameters or {}))
        self.net, self.optimizer, self.optimizer_parameters = net, optimizer, optimizer_parameters or {}
        return self

    def get_parameters(self) -> list[np.ndarray]:
        """Weight matrices and offsets, layer by layer."""
        return [p for layer in self.net.layers(self.net.weights) for p in layer]

    def _fit(self, x: DsArray, y: DsArray, num_batches_per_worker: int, num_epochs: int, every: int = 1, shuffled: bool = False) -> list[np.ndarray]:
        if self.net is None:
            raise RuntimeError("build the network first")
        m, t, net = x.shape[1], y.shape[1], self.net
        name, parameters, batches, size = self.optimizer, self.optimizer_parameters, num_batches_per_worker, len(net.weights)
        rows = x.to_dense().df.join(y.to_dense().df.select("row_idx", F.col("features").alias("y")), "row_idx")
        placed = None
        for epoch in range(0, num_epochs, every):
            if placed is None or shuffled:
                order = hash_order(F.col("row_idx"), epoch if shuffled else 0)
                placed = durable(rows.withColumn("o", order).repartitionById(self.num_workers, (F.col("o") % self.num_workers).cast("int")).sortWithinPartitions("o", "row_idx"))
            start, local = net.weights, min(every, num_epochs - epoch)

            def state(parts: Iterator[pd.DataFrame], start=start, local=local) -> np.ndarray:
                held = [(stack(p["features"], m), stack(p["y"], t)) for p in parts if len(p)]
                if not held:
                    return np.zeros(size + 1)
                v, goal = (np.concatenate(c) for c in zip(*held, strict=True))
                w, rule = start, Optimizer(name, **parameters)
                for _ in range(local):
                    for at in np.array_split(np.arange(len(v)), max(1, min(batches, len(v)))):
                        w = rule.step(w, net.gradient(w, v[at], goal[at]))
                return np.append(w, 1.0)

            total = sum_states(placed, state, size + 1)
            net.weights = total[:-1] / max(total[-1], 1.0)
        return self.get_parameters()

    def fit_synchronous_with_GPU(self, x, y, num_batches_per_worker, num_epochs):  # noqa: N802
        return self._fit(x, y, num_batches_per_worker, num_epochs)

    def fit_synchronous_shuffle_with_GPU(self, x, y, num_batches_per_worker, num_epochs):  # noqa: N802
        return self._fit(x, y, num_batches_per_worker, num_epochs, shuffled=True)

    def fit_synchronous_every_n_epochs_with_GPU(self, x, y, num_batches_per_worker, num_epochs, n_epoch_sync):  # noqa: N802
        return self._fit(x, y, num_batches_per_worker, num_epochs, n_epoch_sync)

    def fit_synchronous_shuffle_every_n_epochs_with_GPU(self, x, y, num_batches_per_worker, num_epochs, n_epoch_sync):  # noqa: N802
        return self._fit(x, y, num_batches_per_worker, num_epochs, n_epoch_sync, shuffled=True)

    fit_asynchronous_with_GPU = fit_synchronous_with_GPU
    fit_asynchronous_shuffle_with_GPU = fit_synchronous_shuffle_with_GPU
    fit_asynchronous_n_epochs_with_GPU = fit_synchronous_every_n_epochs_with_GPU
    fit_asynchronous_shuffle_n_epochs_with_GPU = fit_synchronous_shuffle_every_n_epochs_with_GPU

    def predict(self, x: DsArray) -> DsArray:
        """Outputs of the network, one column per output."""
        net, m, width = self.net, x.shape[1], self.net.sizes[-1]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                if len(p):
                    yield pd.DataFrame({"row_idx": p["row_idx"], "features": list(net.forward(net.weights, stack(p["features"], m))[-1])})

        return DsArray(x.to_dense().df.mapInPandas(run, "row_idx bigint, features array<double>"), (x.shape[0], width))


def average_parameters(workers: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The mean of every weight tensor over workers."""
    if not workers:
        raise ValueError("no workers to average")
    return [np.mean(np.stack(tensors), axis=0) for tensors in zip(*workers, strict=True)]
