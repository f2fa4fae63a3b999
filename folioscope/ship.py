"""Make this package importable on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all Python workers of the session's context, once."""
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="folioscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "folioscope_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(to))
    context._folioscope_shipped = True
