"""Lets Python workers import this package wherever they run."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_GIVEN: set[str] = set()


def reach_workers(spark: SparkSession) -> None:
    """Hands the package's source to the executors, once for an application, as
    an archive that Spark distributes; nothing is done where they run on this
    machine and have it by PYTHONPATH."""
    top = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    here = context.master == "local" or context.master.startswith("local[")
    if context.applicationId in _GIVEN or (here and str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as out:
        for file in sorted((top / "shapewright").rglob("*.py")):
            out.write(file, str(file.relative_to(top)))
    at = Path(tempfile.mkdtemp()) / "shapewright-source.zip"  # the driver's own: Spark serves it to executors
    at.write_bytes(made.getvalue())
    context.addPyFile(str(at))
    _GIVEN.add(context.applicationId)
