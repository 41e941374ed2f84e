"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it on their path already."""
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if ROOT in known or os.path.realpath("folioforge") == str(ROOT / "folioforge"):
        return
    context = spark.sparkContext
    if getattr(context, "_folioforge_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "folioforge.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for path in (ROOT / "folioforge").rglob("*.py"):
            packed.write(path, path.relative_to(ROOT))
    context.addPyFile(str(target))
    context._folioforge_shipped = True


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which goes when the application ends.

    Only a local session may leave that unset; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found}/folioforge-work-{spark.sparkContext.applicationId}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)
    store.deleteOnExit(target)
    return f"{store.makeQualified(target).toString()}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is read several times is computed once."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of what ``written`` gave; nothing may read it later."""
    context = df.sparkSession.sparkContext
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
