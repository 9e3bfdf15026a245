"""Gives the package to executors that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SENT: set[str] = set()


def found_by_workers() -> bool:
    """Whether Python workers start with the repository on their path, by environment or working folder."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and os.path.realpath(p) == os.path.realpath(ROOT) for p in places)


def ship(spark: SparkSession) -> None:
    """Sends the package as an archive, once to each application, where workers don't find it by themselves."""
    application = spark.sparkContext.applicationId
    if application in _SENT or found_by_workers():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "foliospark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(target)
    _SENT.add(application)
