"""Sends the package to Python workers that can't import it from where the driver did."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
SENT: set[str] = set()


def needed() -> bool:
    """Workers look in PYTHONPATH and in the folder that the driver was started in."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return not any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    app = spark.sparkContext.applicationId
    if app in SENT or not needed():
        return
    path = Path(tempfile.mkdtemp()) / "recollect.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((ROOT / "recollect").rglob("*.py")):
            out.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    SENT.add(app)
