"""Makes this package importable in the Python workers of the executors."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's source with the application, once for each Spark context.

    Spark's own file server hands the archive to every executor, also to one that joins later.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), name), "zip", root, name)
    context.addPyFile(archive)
    _shipped[context.applicationId] = archive


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that are no longer referred to.

    They go when the driver's garbage is collected, which may be long after a written table has
    taken their place.
    """
    for _ in range(2):  # what the first round finalises holds what the second one frees
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
