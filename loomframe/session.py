"""Sessions and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(workers: int = 0, app: str = "loomframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; workers <= 0 takes every core of a local master."""
    b = SparkSession.builder.appName(app)
    if "spark.master" not in conf and "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{workers if workers > 0 else '*'}]")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | conf).getOrCreate()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names; a temporary one only where it is unset and local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="loomframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> SparkSession:
    """Send this package to the Python workers, once an application, so they need not have it installed."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("there is no session")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="loomframe-")) / "loomframe.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    return spark
