"""Folder listings and relative paths."""

from __future__ import annotations

import os
import posixpath
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed value: bytes of a drop that needs a confirmation.
LARGE_DROP = 100 * 1024 * 1024
RANGES = 200
ENTRIES = "name string, path string, type string, size long, modified string"


def normalized(path: str) -> str:
    """A path relative to a root, without dots; raises if it is absolute or leads out."""
    clean = posixpath.normpath(path) if path else "."
    if clean.startswith("/") or clean == ".." or clean.startswith("../"):
        raise PermissionError(path)
    return "" if clean == "." else clean


def resolved(root: str, path: str) -> str:
    """The real path of a relative one; raises if it leads out of `root`, be it by links."""
    top = os.path.realpath(root)
    real = os.path.realpath(os.path.join(top, normalized(path)))
    if os.path.commonpath([top, real]) != top:
        raise PermissionError(path)
    return real


def relative(root: str, path: str) -> str:
    """A path below `root` as seen from there; raises if it is not below it."""
    top, real = os.path.realpath(root), os.path.realpath(path)
    if os.path.commonpath([top, real]) != top:
        raise PermissionError(path)
    return normalized(os.path.relpath(real, top).replace(os.sep, "/"))


def drop_split(files: DataFrame, *, name: str = "name", size: str = "size") -> DataFrame:
    """(is_eml, files, bytes, large): what has been dropped on the window, messages and others, and whether it is over LARGE_DROP."""
    kinds = files.groupBy(F.lower(F.col(name)).endswith(".eml").alias("is_eml")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return kinds.withColumn("large", F.col("bytes") > LARGE_DROP)


def listing_order(kind: Column, name: Column) -> list[Column]:
    return [(kind != "directory").asc(), F.lower(name).asc()]


def list_dir(spark: SparkSession, root: str, path: str = "", suffix: str | None = None) -> DataFrame:
    """The visible entries of one folder below `root`, folders first; `suffix` filters files only."""
    top = os.path.realpath(root)
    rows = []
    for e in os.scandir(resolved(root, path)):
        real = os.path.realpath(e.path)
        if e.name.startswith(".") or os.path.commonpath([top, real]) != top or (suffix and not e.is_dir() and not e.name.lower().endswith(suffix)):
            continue
        modified = datetime.fromtimestamp(e.stat().st_mtime, UTC).isoformat()
        rows.append((e.name, os.path.relpath(e.path, top), "directory" if e.is_dir() else "file", 0 if e.is_dir() else e.stat().st_size, modified))
    return spark.createDataFrame(rows, ENTRIES).orderBy(*listing_order(F.col("type"), F.col("name")))


def placed(rows: DataFrame, kind: str, name: str, unique: str, into: str = "place") -> DataFrame:
    """`rows` with their places in a listing, from 1.

    Rows are dealt out in up to RANGES ranges of the order, whose bounds are
    keys chosen by a hash, and numbered within these; a range starts at the
    number of rows before it. So no task gets all rows, and each step gives the
    same if it is run again.
    """
    key = F.struct((F.col(kind) != "directory").alias("a"), F.lower(F.col(name)).alias("b"), F.col(unique).alias("c"))
    keyed = rows.select(F.struct("*").alias("row"), key.alias("key"))
    step = max(1, keyed.count() // (10 * RANGES))
    some = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").orderBy("key").limit(20 * RANGES).collect() if step > 1 else []
    kinds = keyed.schema["key"].dataType
    bounds = rows.sparkSession.createDataFrame([([r["key"] for r in some[10::10]],)], T.StructType([T.StructField("bounds", T.ArrayType(kinds))])).scalar()
    dealt = keyed.withColumn("bounds", bounds).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("key")))).drop("bounds")
    starts, n = [], 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():  # a row for each range
        starts.append((r["range"], n))
        n += r["count"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    number = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return dealt.join(before, "range").select("row.*", (F.col("before") + number).alias(into))
