"""Suffix-array dedup: logarithmic families of sparse suffix arrays over the stretches of text that can repeat.

A byte goes if a MATCH-byte string that covers it also starts anywhere else.

Sampling. Each MATCH-byte string has one least GRAM-byte hash inside it, its
anchor, and equal strings have equal anchors at the same distance from their
start. Strings that follow each other mostly share an anchor; such a run is a
segment: the bytes from the start of its first string to the end of its last.
Segments are cut into BLOCKS by the distance to the anchor, and every string of
a block contains the same bytes around the anchor, the core. So a string can
only recur in a segment of equal core. Cores are counted in Spark, and only
segments whose core recurs go on. Equal segments enter once, with their count.

Index. Segments of a core meet in one task, in batches. A batch becomes a level:
one suffix array of the text from the anchors on, and one of the reversed text
before them. Levels of equal size merge (two sorted runs into one, with longest
common prefixes of neighbours), and each merge is scanned for long matches. A
string at distance x from its anchor is repeated if another segment shares
MATCH - x bytes to the right and x bytes to the left: equal classes in both
arrays. At the end all levels merge, so every pair of segments of a core has
met in one scan.

The segments of one core are dealt out to tasks in chunks of CHUNK_SEGMENTS,
each a family of its own. Strings that recur only in different chunks are found
afterwards: the families of a core of several chunks hand on the names (128-bit
hashes) of their strings, which are counted in Spark, combined before the
shuffle. So no core, however frequent, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import rolling
from postmill.llm.storage import lean, materialize

MATCH, GRAM = 400, 32
#: Text bytes that are sampled at a time; segments that make a batch; bytes of a family after which it ends with its core.
SLICE, BATCH, FAMILY_BYTES = 1 << 18, 2048, 16 << 20
#: Segments of one core in one task, about.
CHUNK_SEGMENTS = 8192
_PLACE = np.uint64((1 << 22) - 1)


def _block(match: int, gram: int) -> int:
    """Distances to the anchor that share a block: half of them."""
    return (match - gram) // 2 + 1


def samples(buf: np.ndarray, at: np.ndarray, match: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Segments of the joined texts `buf` with places `at`: text, first string, strings, distance of the last string, block, hashes of core and segment."""
    block, room = _block(match, gram), np.repeat(at[1:] - 1, np.diff(at))
    for low in range(0, max(len(buf) - match + 1, 0), SLICE):
        piece = buf[low : low + SLICE + match - 1].astype(np.uint64) + np.uint64(1)
        if len(piece) < match:
            return
        s = rolling.prefix_sums(piece, rolling.BYTE_BASE)
        back = rolling.powers(rolling.BYTE_BASE, len(piece) + 1)[1]

        def hashed(a: np.ndarray, b: np.ndarray, s: np.ndarray = s, back: np.ndarray = back) -> np.ndarray:
            return rolling.mix((s[b] - s[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        n = len(piece) - gram + 1
        grams = rolling.mix((s[gram:] - s[:-gram]) * back[:n])
        least = rolling.sliding_min((grams & ~_PLACE) | np.arange(n, dtype=np.uint64), match - gram + 1)
        i = np.flatnonzero(np.arange(low + match, low + match + len(least)) <= room[low : low + len(least)])
        if not len(i):
            continue
        p = (least[i] & _PLACE).astype(np.int64)
        b = (p - i) // block
        new = np.ones(len(i), bool)
        new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(i)]]) - 1
        i0, i1, p, b = i[first], i[last], p[first], b[first]
        core = hashed(p - b * block, p - np.minimum((b + 1) * block - 1, match - gram) + match)
        text = np.searchsorted(at, i0 + low, "right") - 1
        yield {"text": text, "start": i0 + low - at[text], "n": i1 - i0 + 1, "near": p - i1, "block": b, "core": rolling.mix(core + b.astype(np.uint64)), "seg": hashed(i0, i1 + match)}


def _segments(match: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            d, r = (batch.column(k).to_numpy() for k in (0, 1))
            for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
                for x in samples(*rolling.joined(texts[a:b]), match, gram):
                    of = x["text"] + a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x["core"].view(np.int64)), pa.array(x["seg"].view(np.int64)), pa.array(d[of]), pa.array(r[of]), *(pa.array(x[k].astype(np.int32)) for k in ("start", "n", "near", "block"))],
                        names=["core", "seg", "_d", "_r", "start", "n", "near", "block"],
                    )

    return run


def _cut(match: int):
    """From (_text, parts): a row (core, chunk, seg, n, near, block, wide, bytes) for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {k: [] for k in (*_PART, "bytes")}
            size = 0
            for text, parts in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_buffer()
                for x in parts.as_py() or ():
                    for k in _PART:
                        held[k].append(x[k])
                    held["bytes"].append(whole[x["start"] : x["start"] + x["n"] + match - 1].to_pybytes())
                    size += match + x["n"]
                if size > 4 << 20:
                    yield _packed(held)
                    held, size = {k: [] for k in held}, 0
            if size:
                yield _packed(held)

    return run


#: What is known of a segment, with its place among tasks; `wide`: its core has several chunks.
_PART = {"core": pa.int64(), "chunk": pa.int32(), "seg": pa.int64(), "n": pa.int32(), "near": pa.int32(), "block": pa.int32(), "wide": pa.bool_()}


def _packed(x: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x[k], kind) for k, kind in _PART.items()), pa.array(x["bytes"], pa.binary())], names=[*_PART, "bytes"])


class Family:
    """Levels of suffix arrays over aligned segments; `repeated` has a row of flags for each segment, one for each string."""

    def __init__(self, match: int, gram: int) -> None:
        self.match, self.gram, self.block = match, gram, _block(match, gram)
        self.levels: list[tuple[list, list]] = []  # of sorted (suffix, segment): to the right of the anchor, and to the left
        self.near: list[int] = []
        self.n: list[int] = []
        self.of: list[int] = []
        self.name: list[tuple[int, int]] = []
        self.flags: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: list[tuple[int, int, int, int, int, bytes]]) -> None:
        """A batch becomes a level of its own; then levels merge while the last two are of like size."""
        right, left = [], []
        for core, seg, n, near, block, text in rows:
            k, far, key = len(self.n), near + n - 1, core.to_bytes(8, "big", signed=True)
            right.append((key + text[far:].ljust(self.match, b"\0"), k))
            left.append((key + text[:far][::-1].ljust(self.match, b"\0"), k))
            self.name.append((core, seg))
            self.n.append(n)
            self.near.append(near)
            self.of.append(block)
            self.flags.append(np.zeros(n, bool))
            self.size += len(text)
        level = (sorted(right), sorted(left))
        self._scan(level)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        level = (sorted(a[0] + b[0]), sorted(a[1] + b[1]))  # two ascending runs: merged in one linear pass
        self._scan(level)
        self.levels.append(level)

    def finish(self) -> None:
        while len(self.levels) > 1:
            self._merge()

    def _prefixes(self, array: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The segments in the order of the suffix array, and the longest common prefix of each suffix with the one before."""
        width = 8 + self.match
        order = np.fromiter((k for _, k in array), np.int64, len(array))
        lcp = np.zeros(len(array), np.int64)
        for low in range(1, len(array), 4096):
            m = np.frombuffer(b"".join(x for x, _ in array[low - 1 : low + 4096]), np.uint8).reshape(-1, width)
            differ = m[1:] != m[:-1]
            lcp[low : low + 4096] = np.where(differ.any(1), differ.argmax(1), width)
        return order, lcp

    def _scan(self, level: tuple[list, list]) -> None:
        """Flag the strings that occur in two segments of a level."""
        (order, right), (other, left) = self._prefixes(level[0]), self._prefixes(level[1])
        if len(order) < 2:
            return
        back = np.empty(len(self.n), np.int64)
        back[other] = np.arange(len(other))
        turn = back[order]  # the place in the left array of each place in the right one
        near, n, of = (np.array(x)[order] for x in (self.near, self.n, self.of))
        for x in range(self.match - self.gram + 1):
            live = np.flatnonzero((near <= x) & (x < near + n) & (of == x // self.block))
            if len(live) < 2:
                continue
            same = np.cumsum(right < 8 + self.match - x)[live] * len(order) + np.cumsum(left < 8 + x)[turn[live]]
            by = np.argsort(same, kind="stable")
            twin = same[by[1:]] == same[by[:-1]]
            if twin.any():
                hit = np.zeros(len(by), bool)
                hit[by[1:]] |= twin
                hit[by[:-1]] |= twin
                for k in live[hit]:
                    self.flags[order[k]][near[k] + n[k] - 1 - x] = True


_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_NAMES = pa.list_(pa.struct([("k", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))


def _names(text: bytes, n: int, near: int, match: int) -> pa.StructArray:
    """The names of the n strings of a segment; strings at different distances from the anchor differ."""
    v = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    h = [rolling.mix(rolling.windows(v, match, base) + np.arange(near + n - 1, near - 1, -1).astype(np.uint64)).view(np.int64) for base in (rolling.WORD_BASE, rolling.WORD_BASE_2)]
    return pa.StructArray.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(h[0]), pa.array(h[1])], names=["k", "h1", "h2"])


def _indexed(match: int, gram: int):
    """From the rows of :func:`_cut`, sorted by core and chunk: (core, seg, spans, names), spans of strings repeated in the family, names in wide cores."""

    def out(family: Family, named: dict[int, pa.StructArray]) -> pa.RecordBatch:
        family.finish()
        spans = []
        for f in family.flags:
            edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
            spans.append([{"low": int(a), "high": int(b) - 1} for a, b in edge.reshape(-1, 2)])
        lengths = [len(named[k]) if k in named else 0 for k in range(len(spans))]
        flat = pa.concat_arrays([named[k] for k in sorted(named)]) if named else pa.array([], _NAMES.value_type)
        names = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in family.name], pa.int64()), pa.array([s for _, s in family.name], pa.int64()), pa.array(spans, _SPANS), names.cast(_NAMES)], names=["core", "seg", "spans", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, last = Family(match, gram), [], None
        named: dict[int, pa.StructArray] = {}
        for batch in batches:
            for core, chunk, seg, n, near, block, wide, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (core, chunk) != last and family.size + len(rows) * 600 > FAMILY_BYTES:
                    family.add(rows)
                    yield out(family, named)
                    family, rows, named = Family(match, gram), [], {}
                last = (core, chunk)
                if wide:
                    named[len(family.n) + len(rows)] = _names(text, n, near, match)
                rows.append((core, seg, n, near, block, text))
                if len(rows) >= BATCH:
                    family.add(rows)
                    rows = []
        if rows:
            family.add(rows)
        if family.n:
            yield out(family, named)

    return run


def _removals(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            for a, b in rolling.runs(4 * SLICE, [len(t) for t in texts]):
                n_removed, spans, kept = [], [], []
                for k in range(a, b):
                    t, low, high = texts[k], [], []
                    for m in (marks[k].as_py() or ()) if marks[k].is_valid else ():
                        low += [m["start"] + x["low"] for x in m["spans"]]
                        high += [m["start"] + x["high"] + match for x in m["spans"]]
                    by = np.argsort(np.array(low, np.int64), kind="stable")
                    lo, hi = np.array(low, np.int64)[by], np.maximum.accumulate(np.array(high, np.int64)[by]) if low else np.zeros(0, np.int64)
                    new = np.ones(len(lo), bool)
                    new[1:] = lo[1:] > hi[:-1]  # runs that touch are one
                    s = lo[new]
                    e = np.concatenate([hi[np.flatnonzero(new)[1:] - 1], hi[-1:]])
                    n_removed.append(int((e - s).sum()))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                    ends = [0, *(int(x) for x in e)]
                    kept.append(b"".join(t[p:q] for p, q in zip(ends, [*(int(x) for x in s), len(t)], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[3:])],
                    names=["_id", "n_bytes", "n_removed", "spans", "kept", *batch.schema.names[3:]],
                )

    return run


def repeated_spans(occurrences: DataFrame, keyed: DataFrame, *, match: int, gram: int) -> DataFrame:
    """(core, seg, spans) of the segments with repeated strings, from all occurrences of cores that recur."""
    distinct = materialize(
        occurrences.groupBy("core", "seg").agg(F.count("*").alias("times"), F.min(F.struct("_d", "_r", "start")).alias("at"), F.first("n").alias("n"), F.first("near").alias("near"), F.first("block").alias("block")), "suffix-distinct"
    )
    several = materialize(distinct.groupBy("core").agg(F.count("*").alias("segments")).filter("segments > 1"), "suffix-several")
    chunks = F.ceil(F.col("segments") / CHUNK_SEGMENTS)
    part = F.struct("core", F.pmod(F.xxhash64("seg"), chunks).cast("int").alias("chunk"), "seg", "at.start", "n", "near", "block", (chunks > 1).alias("wide"))
    parts = distinct.join(several, "core").select("at._d", "at._r", part.alias("part")).groupBy("_d", "_r").agg(F.collect_list("part").alias("parts"))  # bounded by the document's own length
    # With columns that are not read here, the texts are shuffled as for the last join, so once in all.
    others = [c for c in keyed.columns if c not in ("_d", "_r", "_text")]
    cut = keyed.join(parts, ["_d", "_r"]).select(F.col("_text").cast("binary"), "parts", *others).mapInArrow(lean(_cut(match)), "core long, chunk int, seg long, n int, near int, block int, wide boolean, bytes binary")
    span = "array<struct<low:int,high:int>>"
    indexed = cut.repartition("core", "chunk").sortWithinPartitions("core", "chunk").mapInArrow(lean(_indexed(match, gram)), f"core long, seg long, spans {span}, names array<struct<k:int,h1:long,h2:long>>")
    # Equal segments are one in the index; all their strings are repeated.
    copied = distinct.filter("times > 1").select("core", "seg", F.array(F.struct(F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))).alias("spans"))
    within = lambda x: x.filter("size(spans) > 0").select("core", "seg", "spans").unionByName(copied)
    if not several.filter(F.col("segments") > CHUNK_SEGMENTS).limit(1).count():  # no strings in different chunks
        return within(indexed)
    found = materialize(indexed.filter("size(spans) > 0 or size(names) > 0"), "suffix-found")
    strings = found.select("core", "seg", F.explode("names").alias("x")).select("core", "seg", "x.*")
    again = materialize(strings.groupBy("h1", "h2").agg(F.count("*").alias("m")).filter("m > 1").select("h1", "h2"), "suffix-again")
    across = strings.join(again, ["h1", "h2"]).groupBy("core", "seg").agg(F.collect_list(F.struct(F.col("k").alias("low"), F.col("k").alias("high"))).alias("spans"))
    return within(found).unionByName(across)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, gram: int = GRAM, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of each row: removed runs of bytes, and the bytes that stay.

    The columns named by `carry` come along in a struct `carried`.

    A byte goes if a `match`-byte string that covers it also starts anywhere
    else in any row, the same row included, judged on the input. Matches never
    cross rows. A null text counts as empty. Repeated rows are occurrences like
    any other, so both lose what they share. Ids play no part but to name the
    result; null ids are allowed. Other columns are ignored; an empty table
    gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    keyed = rows.select(F.coalesce(F.col("_id").cast("long"), F.lit(-1)).alias("_d"), F.xxhash64("_id", "_text").alias("_r"), *rows.columns)
    names = "core long, seg long, _d long, _r long, start int, n int, near int, block int"
    found = materialize(keyed.select("_d", "_r", "_text").mapInArrow(lean(_segments(match, gram)), names), "suffix-segments")
    # Written, so that the join shuffles both sides and Spark can split a partition of a frequent core.
    again = materialize(found.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1").select("core"), "suffix-recurring")
    occurrences = materialize(found.join(again, "core"), "suffix-occurrences")
    spans = repeated_spans(occurrences, keyed, match=match, gram=gram)
    marks = occurrences.join(spans, ["core", "seg"]).groupBy("_d", "_r").agg(F.collect_list(F.struct("start", "spans")).alias("marks"))
    id_type = docs.schema[id_col].dataType.simpleString()
    more = [f"carried {rows.schema['carried'].dataType.simpleString()}"] if carry else []
    return (
        keyed.join(marks, ["_d", "_r"], "left")
        .select("_id", "_text", "marks", *rows.columns[2:])
        .mapInArrow(lean(_removals(match)), ", ".join([f"_id {id_type}", "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", *more]))
        .withColumnRenamed("_id", id_col)
    )
