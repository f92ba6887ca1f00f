"""Giving the executors this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: their Python workers then import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_strandlog_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="strandlog-code-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*")):
            if p.suffix in (".py", ".txt"):
                z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._strandlog_shipped = True
