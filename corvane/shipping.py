"""Makes the package importable for Python workers that don't have it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package with the application, unless workers inherit a path that has it."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = spark.sparkContext.master.startswith("local[") and os.getcwd() == _ROOT
    app = spark.sparkContext.applicationId
    if _ROOT in paths or here or app in _shipped:
        return
    _shipped.add(app)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane"), "zip", _ROOT, "corvane"))


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
