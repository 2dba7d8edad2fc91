"""What all estimators share: parameters, cloning, and saving and loading."""

from __future__ import annotations

import importlib
import inspect
import json
import os
import pickle

import numpy as np

from blockframe.dsarray import DsArray, array


class NotFitted(Exception):
    """The estimator has not been fitted."""


def _plain(v):
    if isinstance(v, DsArray):
        return {"__array": np.asarray(v.collect(squeeze=False)).tolist()}
    if isinstance(v, np.ndarray):
        return {"__numpy": v.tolist(), "dtype": str(v.dtype)}
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, dict):
        return {"__dict": [[_plain(k), _plain(x)] for k, x in v.items()]}
    if isinstance(v, (list, tuple)):
        return {"__list": [_plain(x) for x in v], "tuple": isinstance(v, tuple)}
    return v


def _back(v):
    if isinstance(v, dict):
        if "__array" in v:
            return array(np.array(v["__array"], float))
        if "__numpy" in v:
            return np.array(v["__numpy"], dtype=v["dtype"])
        if "__dict" in v:
            return {_back(k) if not isinstance(k, list) else tuple(k): _back(x) for k, x in v["__dict"]}
        out = [_back(x) for x in v["__list"]]
        return tuple(out) if v["tuple"] else out
    return v


def _cbor():
    try:
        return importlib.import_module("cbor2")
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("save_format='cbor' needs the cbor2 package") from e


class Estimator:
    """Base class. Constructor arguments are parameters; what fitting learns is kept in further attributes."""

    #: Attributes that :meth:`save_model` leaves out (plans over training data).
    transient: tuple[str, ...] = ()

    @classmethod
    def parameter_names(cls) -> list[str]:
        return [p for p in inspect.signature(cls.__init__).parameters if p != "self"]

    def get_params(self, deep: bool = True) -> dict:
        return {p: getattr(self, p) for p in self.parameter_names()}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self.parameter_names():
                raise ValueError(f"{type(self).__name__} has no parameter {k!r}")
            setattr(self, k, v)
        return self

    def _check(self, *names: str) -> None:
        if any(getattr(self, n, None) is None for n in names):
            raise NotFitted(f"{type(self).__name__} is not fitted")

    def save_model(self, path: str, overwrite: bool = True, save_format: str = "json") -> None:
        """Write parameters and learned attributes as json, cbor or pickle."""
        if save_format not in ("json", "cbor", "pickle"):
            raise ValueError(f"unknown save_format {save_format!r}")
        if os.path.exists(path) and not overwrite:
            return
        state = {k: _plain(v) for k, v in vars(self).items() if k not in self.transient and not callable(v)}
        state = {"model_name": type(self).__name__, "state": state}
        if save_format == "json":
            body = json.dumps(state).encode()
        else:
            body = _cbor().dumps(state) if save_format == "cbor" else pickle.dumps(state)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(body)
        os.replace(f"{path}.part", path)

    @classmethod
    def load_model(cls, path: str, load_format: str = "json"):
        """Read a saved model; pickle only from files you trust."""
        if load_format not in ("json", "cbor", "pickle"):
            raise ValueError(f"unknown load_format {load_format!r}")
        with open(path, "rb") as f:
            body = f.read()
        if load_format == "json":
            state = json.loads(body)
        else:
            state = _cbor().loads(body) if load_format == "cbor" else pickle.loads(body)
        if state["model_name"] != cls.__name__:
            raise ValueError(f"the file holds a {state['model_name']}")
        out = cls.__new__(cls)
        vars(out).update({k: _back(v) for k, v in state["state"].items()})
        return out


def clone(estimator):
    """An unfitted copy with the same parameters."""
    return type(estimator)(**estimator.get_params())
