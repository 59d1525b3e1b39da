"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or the checkpoint folder set on its context.

    Where neither is set, a local session gets a temporary folder; on a cluster that would be a folder
    of one machine, so there it is an error.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        current = context._jsc.sc().getCheckpointDir()
        place = current.get() if current.isDefined() else None
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        context.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: made once, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/cadenza-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application, unless PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="cadenza-ship-")) / "cadenza_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
