"""Tessera: raster and wavelet-codec analytics on Spark DataFrames."""

from __future__ import annotations

import os

from pyspark import SparkContext


def reach(context: SparkContext | None = None) -> None:
    """Lets Python workers import this package from the folder that the driver has it in.

    A session made later inherits the environment, one that runs already is told; where executors don't
    share that folder the package goes along with `--py-files` and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = context or SparkContext._active_spark_context
    for place in [os.environ, *([context.environment] if context else [])]:
        paths = [p for p in place.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            place["PYTHONPATH"] = os.pathsep.join([root, *paths])


reach()
