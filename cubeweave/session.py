"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, unless their path has it anyway."""
    package = Path(__file__).resolve().parent
    root = package.parent
    if any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="cubeweave-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
