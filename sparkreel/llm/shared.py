"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from .textnum import trimmed


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a new local folder in local mode, else one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        base = "file://" + tempfile.mkdtemp(prefix="sparkreel-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/sparkreel-tables"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows that travel to and from Python at once, as rows may hold texts or sets of many kilobytes.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends in files that survive executors.

    The shuffle files of the write go when it is done, so that the disk never holds those of all steps at once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(kept: StructType, **kinds: str) -> StructType:
    """The schema of ``kept`` followed by fields of the given types."""
    out = StructType(list(kept))
    for name, kind in kinds.items():
        out.add(name, DataType.fromDDL(kind))
    return out


class Idle:
    """Empties a worker's memory of past work once no task has used it for a while; other steps run in the same worker."""

    def __init__(self, empty: Callable[[], None], seconds: float = 2.0):
        self.empty, self.seconds = empty, seconds
        self.lock, self.users, self.timer = threading.Lock(), 0, None

    def __enter__(self) -> None:
        with self.lock:
            self.users += 1
            if self.timer:
                self.timer.cancel()

    def __exit__(self, *_: object) -> None:
        with self.lock:
            self.users -= 1
            self.timer = threading.Timer(self.seconds, self._empty)
            self.timer.daemon = True
            self.timer.start()

    def _empty(self) -> None:
        with self.lock:
            if self.users:
                return
            self.empty()
        trimmed()
