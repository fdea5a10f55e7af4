"""Weather-driven current rating of overhead power lines, as Spark jobs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "spanwatt")
        sc.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(sc.applicationId)
