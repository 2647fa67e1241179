"""A SparkSession with the settings that the operators rely on, and the package on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(name: str = "echogrid", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive plans; everything else comes from the cluster's own configuration or conf."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for an application; Spark fetches them from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "echogrid-modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted([*_ROOT.glob("echogrid/**/*.py"), *_ROOT.glob("corpus_pipeline.py")]):
            z.write(source, source.relative_to(_ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
