"""Session helpers."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession, root: Path) -> None:
    """Send the package to the executors, unless their Python path has it already."""
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_callscope_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted((root / "callscope").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    path = Path(sc._temp_dir) / "callscope.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._callscope_shipped = True
