"""Making this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent.parent
        archive = os.path.join(tempfile.mkdtemp(prefix="assetlode-src-"), "assetlode_src.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
