"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package as a zip once per application, so that workers need no path of their own."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="deckmill-src-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = os.path.join(folder, "deckmill")
        _shipped[app] = shutil.make_archive(base, "zip", root, "deckmill")
        spark.sparkContext.addPyFile(_shipped[app])


def shipped(f):
    """A query that ships the package before it builds its plan."""
    import functools

    @functools.wraps(f)
    def run(spark, d):
        ship(spark)
        return f(spark, d)

    return run
