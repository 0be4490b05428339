"""The folder that driver and executors share, tables cut from their lineage, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import QuernError

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp())
    with zipfile.ZipFile(folder / "quern_code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(folder / "quern_code.zip"))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise QuernError("no_shared_folder", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query once it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and losing an executor loses nothing.

    `tidy` deletes the shuffle files of the writing at its end, which the result doesn't need, not some time later.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._quern_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
