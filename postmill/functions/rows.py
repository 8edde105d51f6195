"""Arrow functions that go through their rows one at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of rows that a task hands to Python at a time, about; a longer row goes alone.
BATCH_BYTES = 4 << 20
#: Bytes of rows whose results are handed back together, about.
PIECE_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let this session hand rows to Python in batches of BATCH_BYTES, unless it has asked for smaller ones.

    What a batch takes, it takes in both the executor and its Python worker,
    several times over; the default of 64 MB is too much for small executors.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")  # a default that is not set reads as none
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if (m := re.fullmatch(r"(-?\d+)\s*([bkmg]?)b?", now.lower())) and not 0 < int(m[1]) * units[m[2]] <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_pieces(f: Callable[..., Any], to: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """What the Python worker runs: results of `f` for each row of batches of columns, in arrays of PIECE_BYTES of rows.

    Only the batch, one row's work and a piece of results are there at a time,
    so a worker's memory does not grow with the rows of its task.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # of tuples of arrays if there are several columns
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            done, held = [], 0
            for k in range(len(columns[0])):
                done.append(f(*(c[k].as_py() for c in columns)))
                held += sum(c.slice(k, 1).nbytes for c in columns)
                if held >= PIECE_BYTES:
                    yield pa.array(done, to)
                    done, held = [], 0
            if done:
                yield pa.array(done, to)

    return run


def by_row(f: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A vectorised UDF of a function of one row's values, null as None, structs as dicts."""
    return F.arrow_udf(in_pieces(f, to_arrow_type(DataType.fromDDL(kind))), kind)
