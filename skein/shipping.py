"""Makes this package importable where tasks run, by sending it along with the application."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, unless the package is on PYTHONPATH or installed as an archive."""
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir() or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    to = os.path.join(tempfile.mkdtemp(prefix="skein-"), "skein_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "skein").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)
