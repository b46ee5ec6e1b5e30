"""Lets Python workers import this package when the driver found it on its own path only."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path. Clusters whose nodes do not share that folder ship it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
