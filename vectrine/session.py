"""Session-level helpers: shared working tables and partition sizing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that
    is unset and the session is local (tests, a laptop) a local folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="vectrine-")) if app not in _OWN else _OWN[app]
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """New, unused path below :func:`shared_dir`, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vectrine/{label}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back.

    Cuts the lineage in a way that survives the loss of executors: the files
    are in the shared folder, not on an executor's disk.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared table; no error if it is gone."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that is no longer needed."""
    for spark, path in list(_MADE):
        if any(path.split("/vectrine/")[1] in f for f in df.inputFiles()[:1]):
            drop(spark, path)
            _MADE.remove((spark, path))


def _clean() -> None:
    for spark, path in _MADE:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(rows: int, rows_each: int, least: int = 1) -> int:
    """Number of partitions that keeps each at about ``rows_each`` rows."""
    return max(least, -(-rows // rows_each))
