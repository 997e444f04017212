"""Analytics over ordered numeric series on Spark: rolling and smoothed statistics, indicators, bars, and graphs of them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this session import the package where it is not installed: adds its folder to their path.

    For local sessions and clusters whose nodes share the folder; elsewhere ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark
