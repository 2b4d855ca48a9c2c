"""The model classes that saved artefacts may name. Loading looks names up
here; nothing else is ever imported on a file's word."""

from __future__ import annotations

import importlib

_KNOWN = {
    "pyspark.ml.regression.RandomForestRegressionModel",
    "pyspark.ml.regression.GBTRegressionModel",
    "pyspark.ml.regression.LinearRegressionModel",
    "loam.models.ensemble.VotingModel",
    "loam.models.extratrees.ExtraTreesModel",
    "loam.models.baseline.MeanModel",
    "loam.models.mlp.MLPModel",
}


def known_class(name: str):
    if name not in _KNOWN:
        raise ValueError(f"{name} is not a model class that can be loaded")
    module, cls = name.rsplit(".", 1)
    return getattr(importlib.import_module(module), cls)
