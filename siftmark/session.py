"""Sessions: the settings the engine wants, and its code on the executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def create(app: str = "siftmark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC and adaptive execution; ``conf`` adds settings, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        to = Path(tempfile.mkdtemp(prefix="siftmark-code-")) / "siftmark.zip"  # the driver serves it to the executors
        to.write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
    return spark
