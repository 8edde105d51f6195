"""Continuous conversion of a watched folder with Structured Streaming."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from postmill.operators.convert import convert_df
from postmill.options import ConvertOptions
from postmill.sources.eml import FILES, is_message

#: Seconds in which a path that was accepted is not accepted again, and for which a file must not have changed.
DEDUPE_SECONDS, STABLE_SECONDS = 5.0, 0.4
#: Seconds between two looks at a file that must find it the same.
POLL_SECONDS = 0.2


def watched(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the message files of a folder: those that are there first, then those that arrive."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[eE][mM][lL]").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", True)
    return stream.load(folder).filter(is_message(F.col("path")))


def settled(spark: SparkSession, paths: list[str], seconds: float = STABLE_SECONDS) -> list[str]:
    """Those of `paths` that are still there, once each has the same size and time in two looks and has not changed for `seconds`."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen: dict[str, tuple[int, int]] = {}
    done, waiting = [], list(paths)
    while waiting:
        late = []
        for path in waiting:
            at = jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(conf)
            if not fs.exists(at):
                continue
            status = fs.getFileStatus(at)
            now = (status.getLen(), status.getModificationTime())
            if seen.get(path) == now and time.time() * 1000 - now[1] >= 1000 * seconds:
                done.append(path)
            else:
                seen[path] = now
                late.append(path)
        waiting = late
        if waiting:
            time.sleep(POLL_SECONDS)
    return done


def _listed(spark: SparkSession, checkpoint: str, number: int) -> list[str]:
    """The message files that the file source listed for a batch, from its log; the batch itself leaves out those that were empty then."""

    def offset(n: int) -> int:
        return json.loads(spark.read.text(f"{checkpoint}/offsets/{n}", wholetext=True).first().value.splitlines()[-1])["logOffset"] if n >= 0 else -1

    entry = F.from_json("value", "path string, batchId long")
    entries = spark.read.text(f"{checkpoint}/sources/0").select(entry.alias("e")).select("e.*").filter(F.col("batchId").between(offset(number - 1) + 1, offset(number))).distinct()
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p)).toString()
    return [p for p in (path(r.path) for r in entries.collect()) if "/_batch-" not in p]


@dataclass
class WatchStatus:
    """What a watcher has seen so far."""

    files_detected: int = 0
    batches: int = 0
    failed_events: int = 0
    last_error: dict | None = None

    def failed(self, path: str | None, message: str) -> None:
        self.failed_events += 1
        self.last_error = {"path": path, "code": "watch_processing_error", "message": message, "stage": "backend"}


def inside(folder: str, paths: list[str]) -> list[str]:
    """Those of `paths` that do not lead out of a local folder by links; folders elsewhere have none."""
    top = urlparse(folder)
    if top.scheme not in ("", "file"):
        return paths
    root = os.path.realpath(top.path)
    return [p for p in paths if os.path.commonpath([root, os.path.realpath(re.sub(r"^file:(//)?(?=/)", "", p))]) == root]


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], *, checkpoint: str, options: ConvertOptions | None = None, once: bool = False, status: WatchStatus | None = None) -> StreamingQuery:
    """Convert what arrives and hand each batch of results to `sink`; the checkpoint remembers what was seen.

    The sink gets a batch again if it fails, under the same number, so it
    should write in a way that can be repeated. A batch waits until its files
    are settled and then reads them; it is done only after that, so a file
    that is still being copied is neither read in part nor lost by a restart.
    A path comes once, so there is nothing for :func:`dedupe_stream` to drop.
    Files that links lead to outside of the folder are left out.

    `status` counts: a message that cannot be converted is a failure, and the
    loop goes on; an error of the sink is one, too, and ends the query.
    """

    def batch(files: DataFrame, number: int) -> None:
        seen = {r.path for r in files.select("path").collect()}  # files_per_batch at most
        ready = inside(folder, settled(spark, sorted(seen | set(_listed(spark, checkpoint, number)))))
        empty = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in ready if p not in seen]
        if empty:
            files = files.unionByName(spark.read.format("binaryFile").load(empty))
        if len(ready) < len(seen):
            files = files.filter(F.col("path").isin(ready))  # files_per_batch at most
        results = convert_df(files, options)  # contents are read when this runs, whole as they are now
        if status is None:
            return sink(results, number)
        results = results.persist()
        try:
            sink(results, number)
            status.files_detected += len(ready)
            status.batches += 1
            for r in results.filter("not success").select("source", "error").collect():
                status.failed(r.source, r.error)
        except Exception as e:
            status.failed(None, str(e) or type(e).__name__)
            raise
        finally:
            results.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": "300 milliseconds"}
    return watched(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def accepted(times: Column, gap: Column) -> Column:
    """Of ascending times those that are accepted: each is at least `gap` after the last accepted one."""
    start = F.array_compact(F.array(F.get(times, F.lit(0))))
    return F.aggregate(times, start, lambda kept, t: F.when(t >= F.element_at(kept, -1) + gap, F.concat(kept, F.array(t))).otherwise(kept))


def _folded(gap: float):
    """From (key, at, order), sorted: with `fresh`. The state is one number, however many events a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, float("-inf")
        for batch in batches:
            fresh = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    key, last = k, float("-inf")
                new = t >= last + gap
                last = t if new else last
                fresh.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.bool_())], names=[*batch.schema.names, "fresh"])

    return run


def dedupe(events: DataFrame, *, key: list[str], at: str, order: str, gap: float = DEDUPE_SECONDS) -> DataFrame:
    """(key, at, order, fresh): which events the watcher accepts. `at` is in seconds; equal times follow `order`.

    An event that is dropped does not extend the pause, so this is a fold over
    the events of a key and not a comparison with the one before. A window
    function cuts the events of a key where a pause lies between two; the first
    of such a run is always accepted, so runs are dealt out to tasks by
    themselves and gone through as a sorted stream.
    """
    w = Window.partitionBy(*key).orderBy(at, order)
    close = F.coalesce(F.col(at) - F.lag(at).over(w) < gap, F.lit(False))
    runs = events.withColumn("_close", close).withColumn("_run", F.count_if(~F.col("_close")).over(w))
    rows = runs.select(F.struct(*key, "_run").alias("k"), F.col(at).alias("t"), F.col(order).alias("o"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in (*key, at, order)}
    schema = f"k struct<{','.join(f'{c}:{kinds[c]}' for c in key)},_run:bigint>, t {kinds[at]}, o {kinds[order]}, fresh boolean".replace(">,_run:bigint>", ",_run:bigint>")
    folded = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(_folded(gap), schema)
    return folded.select(*(F.col("k").getField(c).alias(c) for c in key), F.col("t").alias(at), F.col("o").alias(order), "fresh")


def stable(files: DataFrame, seconds: float = STABLE_SECONDS) -> DataFrame:
    """Only files that have not changed for a while; the listing evaluates this, contents are not read for it."""
    return files.filter(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds)))


class _LastAccepted:
    """Keyed state of the exact rule: the time of the last accepted event of a path."""

    def __init__(self, gap: float) -> None:
        self.gap = gap

    def run(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        events = pd.concat(list(batches)).sort_values("at", kind="stable")
        fresh = []
        for at in events["at"]:
            new = last is None or at - last >= self.gap
            last = at if new else last
            fresh.append(new)
        state.update((last,))
        yield events.assign(path=key[0], fresh=fresh)[["path", "at", "fresh"]]


def dedupe_stream(events: DataFrame, gap: float = DEDUPE_SECONDS) -> DataFrame:
    """A stream (path string, at double seconds) with `fresh`, by the exact rule of :func:`dedupe`, across batches.

    The state holds one number for each path. Events that arrive after a later
    batch was decided are judged against the last accepted one then.
    """
    kind = "path string, at double, fresh boolean"
    return events.select("path", "at").groupBy("path").applyInPandasWithState(_LastAccepted(gap).run, kind, "last double", "append", "NoTimeout")
