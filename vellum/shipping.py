"""Lets Python workers find this package where it is not installed."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's folder to the path that workers start with."""
    environment = spark.sparkContext.environment
    root, had = str(Path(__file__).resolve().parents[1]), environment.get("PYTHONPATH", "")
    if root not in had.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, had]))
