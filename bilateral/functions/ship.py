"""Sends the package to the executors of a session, so that its functions can be imported there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of this package to the session's files, once per application (executors fetch it from the driver)."""
    sc = spark.sparkContext
    if getattr(sc, "_bilateral_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="bilateral-")) / "bilateral.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._bilateral_shipped = True
