"""Shared pieces of the training-data operators: tables, the shared folder, cut lineage, files."""

from __future__ import annotations

import ctypes
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker handles at once; Spark bounds the bytes of its batches, this the lists made of them.
BATCH_ROWS = 1000
#: Groups that may be hot at most, as they hold more than this part of all rows, and rows of a hot group at least.
HOT_GROUPS, HOT_ROWS = 10_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark's readers open it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` of a Python worker that holds little once it has ended.

    Spark keeps workers for later tasks, and each would keep the most memory that it ever took.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def store_of(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path; one without scheme lies in the cluster's default store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local-mode session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    store, target = store_of(spark, found)
    return store.makeQualified(target).toString()


def session_dir(spark: SparkSession) -> str:
    """The folder for this application's working files, which goes when the application ends."""
    path = posixpath.join(shared_dir(spark), f"folioforge-{spark.sparkContext.applicationId}")
    store, target = store_of(spark, path)
    store.mkdirs(target)
    store.deleteOnExit(target)
    return path


def run_dir(spark: SparkSession, label: str) -> str:
    """A new name inside the folder of this application."""
    return posixpath.join(session_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark drops the shuffle files of each action as it ends, and sends Python workers few rows at once.

    The session's own settings come back.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, label: str, kept: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: work is done once, lineage is cut and no shuffle files stay.

    ``kept`` gets the folder's name, for those who delete it before the application ends.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    with tidy(spark):
        df.write.parquet(path)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store."""
    for path in paths:
        store, target = store_of(spark, path)
        store.delete(target, True)


def open_store(uri: str):
    """(file system, path) of a URI for the executors' own file formats."""
    from pyarrow import fs

    local = uri.startswith("file:/") and not uri.startswith("file://")  # as Hadoop writes it
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if local else uri)


def looked_up(rows: DataFrame, facts: DataFrame, on: Sequence[str], n: str, total: int, groups: int = HOT_GROUPS) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row for each key, such that no key lands in one task.

    ``facts`` says in column ``n``, which is dropped, how many rows a key has; they add up to ``total``. Keys
    with more than ``total / groups`` rows number ``groups`` at most, so these facts are broadcast;
    all others meet in a shuffle. ``facts`` should be written, as it is read twice. Keys are not null.
    """
    hot = F.col(n) > max(HOT_ROWS, total // groups)
    values = [c for c in facts.columns if c not in (*on, n)]
    few = facts.where(hot).select(*on, F.struct(F.lit(True).alias("_"), *values).alias("_hot"))
    if few.isEmpty():
        return rows.join(facts.drop(n), list(on)).select(*rows.columns, *values)
    marked = rows.join(F.broadcast(few), list(on), "left")
    common = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    rare = marked.where("_hot is null").drop("_hot").join(facts.where(~hot).drop(n), list(on)).select(*rows.columns, *values)
    return common.union(rare)
