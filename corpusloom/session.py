"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_elsewhere(spark: SparkSession) -> bool:
    """Is the cluster's shared folder on a file system that isn't mounted here?"""
    return urlparse(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").scheme not in ("", "file")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers, wherever the session came from.

    Batches to Python are bounded by bytes, as texts are long: 4 MiB unless the session's own configuration says otherwise."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "4m")
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = urlparse(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").path if not shared_elsewhere(spark) else ""
        if not at or not os.path.isdir(at):
            at = tempfile.mkdtemp(prefix="corpusloom-code-")  # the driver serves the file to executors as long as it lives
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        path = os.path.join(at, "corpusloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def build(app: str = "corpusloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
