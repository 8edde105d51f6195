"""Written intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read, never a recomputation of
everything before it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
#: Bytes of rows that a task hands to Python at a time, about; a longer row goes alone.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let this session hand rows to Python in batches of BATCH_BYTES, unless it has asked for smaller ones.

    What a batch takes, it takes in both the executor and its Python worker,
    several times over; the default of 64 MB is too much for small executors.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if now and (m := re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", now.lower())) and not 0 < int(m[1]) * units[m[2]] <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, a function for mapInArrow, which gives memory back at the end of its task: workers outlive tasks, and idle ones would keep the most they ever had."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: the session's checkpoint folder. A session of one machine may have none and gets one of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL_ROOT.setdefault(spark.sparkContext.applicationId, "")
        if not root:
            root = _LOCAL_ROOT[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="postmill-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{scratch_root(spark)}/postmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    for part in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/postmill/" in part:
            path = spark._jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
