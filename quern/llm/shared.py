"""Files in the folder that driver and executors share, beside the tables of quern.shared."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, new_path, saved, ship  # noqa: F401


def local_path(url: str) -> str:
    """A shared folder as the file system shows it: what is memory-mapped must be a mounted path."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {url}")
    return url


def new_folder(spark: SparkSession, name: str) -> str:
    path = local_path(new_path(spark, name))
    os.makedirs(path, exist_ok=True)
    return path


def write_array_file(path: str, put) -> None:
    """put(temporary path), then an atomic rename: a task that runs twice leaves one whole file."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    put(temporary)
    os.replace(temporary, path)


def remove_folder(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column, summed in one scan: Catalyst's own estimates know files but not joins or local rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
