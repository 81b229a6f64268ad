"""Shared plumbing: table reads, scratch tables in the shared folder, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch handed to Python, so that long texts cannot add up.
ARROW_BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and see that executors can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_quarry_shipped", False):
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver serves the file from here while it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(archive)
        context._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + os.path.join(tempfile.gettempdir(), "quarry-work")
    return base


class Scratch:
    """Tables written to the shared folder: lineage ends there, lost executors cost nothing.

    What a query has not dropped, since its result reads it, goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written under ``label`` and read again."""
        df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.path(label))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_remembered: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """What this process remembers from one task to the next for the maps that keep ``name``."""
    return _remembered.setdefault(name, {})


def forget(keep: str | None = None) -> None:
    """Drop what this process remembers, but for ``keep``.

    A map calls this by name: the module's own variables would travel with it as copies.
    """
    for name in [n for n in _remembered if n != keep]:
        del _remembered[name]


def tidy(run, keep: str | None = None):
    """``run``, a map over Arrow batches, that hands free memory back when it ends: workers outlive their tasks.

    What other maps left remembered in the worker goes before it begins, but for ``keep``.
    """

    def tidied(batches):
        forget(keep)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return tidied


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Up to so many rows of a list of keys are broadcast, more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20
#: Most keys that are taken for hot; a key with a smaller share of the rows than 1 in so many never is.
HOT_KEYS = 1 << 16


def without(rows: DataFrame, unwanted: DataFrame, condition) -> DataFrame:
    """``rows`` without those that ``condition`` matches to a row of ``unwanted`` (a written table)."""
    small = unwanted.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(unwanted) if small else unwanted, condition, "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], n: str = "n", most: int = BROADCAST_KEYS) -> DataFrame:
    """Left join of ``rows`` to ``table``, a written table with one row per key and the number ``n`` of rows that have it.

    A table of up to ``most`` rows is broadcast.  Of a larger one only the hot keys are, whose
    number is bounded by their share of the rows; the rest is a shuffle join without hot keys.
    """
    size, total = table.agg(F.count("*"), F.sum(n)).first()
    if size <= most:
        return rows.join(F.broadcast(table.drop(n)), on, "left")
    hot = F.col(n) > max(1000, total / HOT_KEYS)
    few, many = F.broadcast(table.where(hot).drop(n)), table.where(~hot).drop(n)
    return rows.join(few, on).unionByName(rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti").join(many, on, "left"))


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores in front until no frame has such a column (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
