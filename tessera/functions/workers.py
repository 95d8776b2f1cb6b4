"""Sends the package to Python workers, which need not have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_workers.zip"
    path.write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    sc._tessera_shipped = True
