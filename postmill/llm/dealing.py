"""Dealing large groups out to tasks in pairs of chunks, and reading the groups of a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """`rows` (with a column node) with columns i, j and side: a copy of each for every pair of chunks of its group that it belongs to.

    A group of up to `chunk` rows is one chunk and its rows are not copied;
    groups of one row are left out. Any two rows of a group meet in one pair
    of chunks, so no task gets more than two chunks, about, of one group.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_m"))
    chunks = F.ceil(F.col("_m") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least(F.col("_c"), o).alias("i"), F.greatest(F.col("_c"), o).alias("j"), (F.col("_c") > o).cast("int").alias("side")))
    dealt = rows.join(sizes.filter("_m > 1"), key).withColumns({"_k": chunks, "_c": mine}).withColumn("_x", F.explode(spread))
    return dealt.select(*rows.columns, "_x.i", "_x.j", "_x.side")


def deal_strays(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """`rows` (with columns node, few, many and a boolean astray) with columns i and j: the strays of a group against all of it.

    `few` and `many` are the sizes of the group's strays and of the group. A
    stray meets every member in one pair (i, j) of a chunk of strays and a
    chunk of members; a member that is no stray is copied once for each chunk
    of strays, not for each chunk of the group.
    """
    of = lambda n: F.greatest(F.ceil(F.col(n) / chunk), F.lit(1)).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("node"), of(n).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), of(n) - 1)
    as_member = F.transform(every("few"), lambda i: F.struct(i.alias("i"), mine("many").alias("j"), F.lit(False).alias("own")))
    as_stray = F.transform(every("many"), lambda j: F.struct(mine("few").alias("i"), j.alias("j"), F.lit(True).alias("own")))
    dealt = rows.withColumn("_x", F.explode(F.when(F.col("astray"), F.concat(as_member, as_stray)).otherwise(as_member)))
    return dealt.select(*rows.columns, "_x.i", "_x.j", "_x.own")


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """Dealt `rows` with those of one group and pair of chunks next to each other."""
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The tables of equal `key` in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        start = 0
        for k, x in enumerate(keys):
            if x != last:
                if start < k:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, x
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
