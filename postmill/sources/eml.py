"""Scans of message files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the binary file source gives.
FILES = "path string, modificationTime timestamp, length long, content binary"


def is_message(path: Column) -> Column:
    """A watched message file: ends in .eml in any case, and is in no batch folder."""
    return ~F.contains(path, F.lit("/_batch-")) & F.lower(path).endswith(".eml")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content) of all .eml files below a folder.

    Local folders are listed by :func:`local_messages`, so that links do not
    lead out and unreadable folders are passed over. Elsewhere Spark lists the
    folder; its source leaves out names that begin with `_` or `.`. Size and
    time filters on the result reach the listing; `content` is read only if it
    is selected.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        return scan_local(spark, path.toUri().getPath())
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.[eE][mM][lL]").load(root)


def local_messages(root: str) -> list[str]:
    """The regular .eml files below a local folder, hidden ones too, that do not lead out of it, sorted by path components."""
    top = os.path.realpath(root)
    found = []
    for folder, _, names in os.walk(top, onerror=lambda e: None):
        for name in names:
            path = os.path.join(folder, name)
            real = os.path.realpath(path)
            if name.lower().endswith(".eml") and os.path.isfile(real) and os.path.commonpath([top, real]) == top:
                found.append(path)
    return sorted(found, key=lambda p: p.split(os.sep))


def scan_local(spark: SparkSession, root: str) -> DataFrame:
    """The same columns for what :func:`local_messages` lists."""
    paths = local_messages(root)
    return spark.read.format("binaryFile").load([f"file://{p}" for p in paths]) if paths else spark.createDataFrame([], FILES)


def validated(path: str) -> str:
    """The real path of one message file; raises if it is missing or no .eml file."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(".eml"):
        raise ValueError(f"not an .eml file: {path}")
    return os.path.realpath(path)


def path_order(path: Column) -> Column:
    """Orders paths by their components."""
    return F.split(path, "/")


def backlog(root: str) -> list[str]:
    """The message files that a watcher finds when it starts: those of each folder together, by name, none of batch folders."""
    found = [p for p in local_messages(root) if "/_batch-" not in p]
    return sorted(found, key=lambda p: (os.path.dirname(p).split(os.sep), os.path.basename(p)))


def job_files(mode: str, input_path: str, cabinet: str) -> list[str]:
    """The files of a job: one message, or all below a folder. Nothing may lie in the cabinet; raises ValueError if something is wrong."""
    real, kept = os.path.realpath(os.path.expanduser(input_path)), os.path.realpath(cabinet)
    if os.path.commonpath([real, kept]) == kept:
        raise ValueError(f"sources in the cabinet are not allowed: {real}")
    if mode == "directory":
        if not os.path.isdir(real):
            raise ValueError(f"no such folder: {real}")
        return local_messages(real)
    if not os.path.isfile(real):
        raise ValueError(f"no such file: {real}")
    if not real.lower().endswith(".eml"):
        raise ValueError(f"not an .eml file: {real}")
    return [real]
