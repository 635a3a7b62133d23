"""Sends this package to the executors, whose Python workers may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, before the first Python function of the package runs on executors."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quern-ship-")) / "quern.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
