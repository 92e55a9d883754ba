"""Lets Python workers import this package, wherever they start."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def importable(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they needn't have the driver's folders.

    The driver serves the file (some hundred kilobytes) as long as the application runs.
    """
    if (app := spark.sparkContext.applicationId) in _SENT:
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(made := f"{folder}/{package.name}-{app}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(made)
    _SENT.add(app)
