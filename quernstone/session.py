"""What a session needs so that executors can run the engine's Python."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
_SHIPPED: set[str] = set()


def _workers_find_it(spark: SparkSession) -> bool:
    """Workers get PYTHONPATH and, in local mode, the driver's working folder."""
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return ROOT in paths or (spark.sparkContext.master.startswith("local") and os.path.isdir("quernstone"))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless they find it by
    themselves."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or _workers_find_it(spark):
        return
    folder = tempfile.TemporaryDirectory(prefix="quernstone-")
    atexit.register(folder.cleanup)  # Spark serves the file from here as long as it runs
    path = os.path.join(folder.name, "quernstone.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "quernstone")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """run, after the package is where executors can import it."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return wrapped
