"""What the operators need from the session: their code on the workers, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path of their own to it.

    The archive is made on the driver only to be handed to Spark, which distributes it; no data passes through it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="aerolith-code-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none and runs in one process (tests, local runs) a folder of this machine is made;
    on a cluster without the setting this raises, as a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    made = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (made.get() if made.isDefined() else None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"aerolith-{os.getpid()}")
    if made.isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once, as a table in the shared folder, in a folder for each value of ``by``; later reads neither repeat its plan nor lose it with an executor."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/aerolith/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``cut`` has left in the shared folder; call it when no result of the session is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/aerolith")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
