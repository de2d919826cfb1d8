"""Executors get this package from the driver, so that a query runs wherever it was imported from."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to this application's executors, once. Spark serves the file from the driver."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='stratal-package-')}/{package.name}_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, after ship()."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
