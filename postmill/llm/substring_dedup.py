"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is removed if its word sequence also starts in a document of smaller
id; the removed windows of a document merge into maximal intervals of words.

Which windows need a row is found first. Every window of WINDOW words has one
least hash among the hashes of its ANCHOR-word windows, and equal windows have
equal least hashes. So a window can only recur if its least hash does. About
one word in twenty gives such a hash; these are counted, and only windows whose
least hash occurs under a smaller and a larger id can matter. Neighbouring
windows with one least hash form a run. Equal runs (128 bits) are counted
first: in all but the first document every window of the run goes. Then the
windows of one copy of each run, where runs of one least hash differ, are
hashed one by one (96 bits) and counted. Nothing is lost by that, and the large
shuffles are of candidates, not of all windows.

Counts are combined before they are shuffled, so a passage in a third of all
documents is one row per task. The joins back to documents are plain equi-joins
of which Spark splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import rolling
from postmill.llm.storage import lean, materialize

WINDOW, ANCHOR = 50, 8
#: Text bytes that are hashed at a time.
SLICE = 1 << 19
#: A null id counts as larger than all others.
LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _r, id, text): the order of a document, and a hash that tells rows with one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    return rows.select(F.coalesce(F.col("_id").cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64("_id", "_text").alias("_r"), "_id", "_text")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, word starts and ends, word hashes, and the first word of each text, with the end at last."""
    buf, at = rolling.joined(texts)
    starts, ends = rolling.word_spans(buf)
    return buf, starts, ends, rolling.word_hashes(buf, starts, ends), np.searchsorted(starts, at)


def _least(words: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that lie within a text, by their first word, and the least anchor hash of each."""
    least = rolling.sliding_min(rolling.windows(words, anchor, rolling.WORD_BASE), window - anchor + 1)
    room = np.repeat(first[1:], np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= room)
    return at, least[at]


def _runs(window: int, anchor: int):
    """Runs of windows with one least hash: (h, seg, _d, _r, pos, n), seg the hash of all words of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            d, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
                _, _, _, words, first = _words(texts[a:b])
                at, least = _least(words, first, window, anchor)
                doc = np.searchsorted(first, at, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                n = np.diff(np.concatenate([start, [len(at)]]))
                low, of = at[start], doc[start]
                seg = rolling.spans(words, low, low + n + window - 1, rolling.WORD_BASE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[start].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(d[of + a]), pa.array(r[of + a]), pa.array((low - first[of]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["h", "seg", "_d", "_r", "pos", "n"],
                )

    return run


def _windows(window: int):
    """From (_d, _text, parts): the 96-bit hashes of the windows of each part, with their place k in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            d, parts = batch.column(0).to_numpy(), batch.column(2)
            for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
                _, _, _, words, first = _words(texts[a:b])
                x = parts.slice(a, b - a)
                doc = np.repeat(np.arange(b - a), x.value_lengths().to_numpy())
                h, seg, pos, n = (f.to_numpy() for f in x.flatten().flatten())
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(first[doc] + pos, n) + k
                h1 = rolling.windows(words, window, rolling.WORD_BASE)[at].view(np.int64)
                h2 = (rolling.windows(rolling.mix(words + np.uint64(1)), window, rolling.WORD_BASE_2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.repeat(d[a + doc], n)), pa.array(np.repeat(h, n)), pa.array(np.repeat(seg, n)), pa.array(k.astype(np.int32))], names=["h1", "h2", "_d", "h", "seg", "k"])

    return run


def _removals(window: int):
    """From (_id, _text, marks): words, removed intervals and the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            marks = batch.column(2)
            for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
                n_words, n_removed, spans, kept = [], [], [], []
                for k in range(a, b):
                    words = texts[k].split()  # ASCII white space, as in the contract, for bytes
                    gone = np.zeros(len(words) + 1, np.int32)
                    for m in (marks[k].as_py() or ()) if marks[k].is_valid else ():
                        if m["whole"]:
                            gone[m["pos"]] += 1
                            gone[m["pos"] + m["n"] + window - 1] -= 1
                        elif m["ks"]:
                            at = m["pos"] + np.array(m["ks"])
                            np.add.at(gone, at, 1)
                            np.add.at(gone, at + window, -1)
                    covered = np.cumsum(gone[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                    n_words.append(len(words))
                    n_removed.append(int(covered.sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    kept.append(b" ".join(words[i] for i in np.flatnonzero(~covered)) if len(edge) else b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["_id", "n_words", "n_removed", "spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of each row: removed intervals of words, and the words that stay, joined by a space.

    A word goes if a window of `window` words that covers it also starts in a
    row with a smaller id, judged on the input. A null id is larger than all
    others; rows with one id do not remove each other's words. A null or empty
    text has no words; shorter texts than a window lose nothing. Repeated rows
    give repeated results; other columns are ignored; an empty table gives an
    empty one.
    """
    keyed = _keyed(docs, id_col, text_col)
    names = "h long, seg long, _d long, _r long, pos int, n int"
    found = materialize(keyed.select("_d", "_r", "_text").mapInArrow(lean(_runs(window, anchor)), names), "substring-runs")
    # Written, so that the join shuffles both sides and Spark can split a partition of a frequent run.
    shared = materialize(found.groupBy("h").agg(F.min("_d").alias("low"), F.max("_d").alias("high")).filter("low < high").select("h"), "substring-recurring")
    runs = materialize(found.join(shared, "h"), "substring-shared")
    distinct = materialize(runs.groupBy("h", "seg").agg(F.min(F.struct("_d", "_r", "pos")).alias("at"), F.first("n").alias("n")), "substring-distinct")
    # These two are written for the same reason.
    several = materialize(distinct.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "substring-several")
    parts = distinct.join(several, "h").select("at._d", "at._r", F.struct("h", "seg", "at.pos", "n").alias("part"))
    wanted = parts.groupBy("_d", "_r").agg(F.collect_list("part").alias("parts"))  # bounded by the document's own length
    # With _id, which is not read here, the texts are shuffled as for the last join, so once in all.
    hashed = materialize(keyed.join(wanted, ["_d", "_r"]).select("_d", "_text", "parts", "_id").mapInArrow(lean(_windows(window)), "h1 long, h2 int, _d long, h long, seg long, k int"), "substring-windows")
    counted = materialize(hashed.groupBy("h1", "h2").agg(F.min("_d").alias("low"), F.max("_d").alias("high")).filter("low < high").select("h1", "h2", "low"), "substring-counted")
    early = hashed.join(counted, ["h1", "h2"]).filter("low < _d").groupBy("h", "seg").agg(F.collect_list("k").alias("ks"))
    first = distinct.select("h", "seg", F.col("at._d").alias("_d"))
    none = F.lit(None).cast("array<int>")
    later = runs.join(first.withColumnRenamed("_d", "low"), ["h", "seg"]).filter("low < _d").select("_d", "_r", "pos", "n", F.lit(True).alias("whole"), none.alias("ks"))
    own = runs.join(first, ["h", "seg", "_d"]).join(early, ["h", "seg"]).select("_d", "_r", "pos", "n", F.lit(False).alias("whole"), "ks")
    marks = later.union(own).groupBy("_d", "_r").agg(F.collect_list(F.struct("pos", "n", "whole", "ks")).alias("marks"))
    id_type = docs.schema[id_col].dataType.simpleString()
    removed = keyed.join(marks, ["_d", "_r"], "left").select("_id", "_text", "marks").mapInArrow(
        lean(_removals(window)), f"_id {id_type}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
    )
    return removed.withColumnRenamed("_id", id_col)

