"""Saving and loading fitted models: one Parquet table a model, in any folder that Spark can reach.

A model's attributes are stored as plain values and arrays; nothing is pickled, and only the classes listed here are built.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from ..operators.cluster import Mixture
from ..operators.lda import MatrixPriorLDA
from ..operators.network import Adam, Autoencoder, Layers, ScaSE, SpectralNet, SpectralNetwork, SpectralTrainer
from ..operators.spectral import ScalableEmbedding

CLASSES = {c.__name__: c for c in (Adam, Autoencoder, Layers, MatrixPriorLDA, Mixture, ScaSE, ScalableEmbedding, SpectralNet, SpectralNetwork, SpectralTrainer)}


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Writes a model, replacing what is at `path`."""
    arrays: list[np.ndarray] = []

    def plain(x: Any) -> Any:
        if isinstance(x, np.ndarray):
            arrays.append(np.ascontiguousarray(x))
            return {"array": len(arrays) - 1, "dtype": x.dtype.str, "shape": list(x.shape)}
        if type(x).__name__ in CLASSES:
            return {"model": type(x).__name__, "values": {k: plain(v) for k, v in vars(x).items()}}
        if isinstance(x, (list, tuple)):
            return {"list": [plain(v) for v in x]}
        if isinstance(x, np.generic):
            return {"value": x.item()}
        if x is None or isinstance(x, (bool, int, float, str)):
            return {"value": x}
        raise TypeError(f"{type(x).__name__} can't be saved")

    head = json.dumps(plain(model)).encode()
    rows = [(-1, bytearray(head))] + [(i, bytearray(a.tobytes())) for i, a in enumerate(arrays)]
    spark.createDataFrame(rows, "part int, value binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Any:
    """The model that was saved at `path`."""
    parts = {r["part"]: bytes(r["value"]) for r in spark.read.parquet(path).collect()}

    def built(x: dict) -> Any:
        if "array" in x:
            return np.frombuffer(parts[x["array"]], np.dtype(x["dtype"])).reshape(x["shape"]).copy()
        if "model" in x:
            out = object.__new__(CLASSES[x["model"]])
            vars(out).update({k: built(v) for k, v in x["values"].items()})
            return out
        return [built(v) for v in x["list"]] if "list" in x else x["value"]

    return built(json.loads(parts[-1]))
