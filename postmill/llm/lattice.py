"""Embedding near-dedup by lattice hashing.

A vector's unit form is projected to BLOCKS times eight dimensions, several
tables with projections of their own, and each block of eight is decoded to the
nearest point of the E8 lattice. A table's cell is named by its points. Vectors
are kept in their own cell and also look into neighbouring cells: those in
which one block is replaced by one of the next nearest lattice points.

Cells are counted as narrow rows first. Only cells in which two vectors meet
get the vectors; there every pair is verified by its cosine in double
precision. A cell hands on links, or, if it is large, a spanning forest of
them, so a group of copies gives rows in proportion to its size, not to its
square. Cells of over CHUNK vectors are dealt out in pairs of chunks. Direct
links are then counted within components, block by block; components of over
COUNTED vectors are dealt out likewise, each vector once for each chunk. Links
of a group of m near copies are of the order of m * m, so counting them is, too;
equal vectors count as one with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import rolling
from postmill.llm.components import connected_components
from postmill.llm.dealing import deal, gathered, groups
from postmill.llm.storage import lean, materialize

COSINE = 0.95
#: Tables, blocks of eight dimensions, neighbouring cells probed in each block, and the scale of the projections.
TABLES, BLOCKS, PROBES, SCALE = 12, 2, 4, 0.62
#: Vectors of one cell that one task compares at once; cells up to SMALL give their links as they are.
CHUNK, SMALL = 2048, 16
#: Of a component: vectors, and their bytes, that make a chunk; a task compares two. Rows that are compared at a time.
COUNTED, COUNTED_BYTES, BLOCK = 8192, 16 << 20, 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    i, j = np.triu_indices(8, 1)
    pairs = np.zeros((len(i) * 4, 8))
    for k, (a, b) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1))):
        rows = np.arange(len(i)) + k * len(i)
        pairs[rows, i], pairs[rows, j] = a, b
    signs = 0.5 - ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate([pairs, signs[(signs < 0).sum(1) % 2 == 0]])


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _name(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of lattice points (doubled, they are integers)."""
    h = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        h = rolling.mix(h + np.rint(2 * points[:, k]).astype(np.int64).view(np.uint64))
    return h


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> Iterator[tuple[int, np.ndarray]]:
    """For each table the cell names of each vector: its own first, then those that it probes."""
    for t in range(tables):
        rng = np.random.default_rng([8, t, unit.shape[1]])
        parts = []
        for _ in range(blocks):
            y = scale * unit @ rng.standard_normal((unit.shape[1], 8)) + rng.uniform(0, 1, 8)
            own = decode(y)
            near = np.argsort(-((y - own) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
            parts.append([_name(own), *(_name(own + ROOTS[near[:, k]]) for k in range(probes))])
        seed = rolling.mix(np.array([t + 1000 * unit.shape[1]], np.uint64))
        own = [p[0] for p in parts]
        found = [own] + [[*own[:b], p[k], *own[b + 1 :]] for b, p in enumerate(parts) for k in range(1, probes + 1)]
        names = []
        for choice in found:
            h = np.repeat(seed, len(unit))
            for part in choice:
                h = rolling.mix(h + part)
            names.append(h)
        yield t, np.stack(names, 1)


def units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of vectors of one length, given as bytes of doubles."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1)[:, None]  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(1))[:, None]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, embedding): (id, raw), raw null for vectors that link with nothing."""
    for batch in batches:
        raw = []
        for x in batch.column(1):
            v = np.array([np.nan], float) if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            raw.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["_v", "raw"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, raw): (cell, node, own)."""
    for batch in batches:
        node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        size = np.array([len(x) for x in raw])
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            for low in range(0, len(at), 2000):
                rows = at[low : low + 2000]
                for _, names in cells(units([raw[k] for k in rows])):
                    own = np.zeros(names.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64).ravel()), pa.array(np.repeat(node[rows], names.shape[1])), pa.array(own.ravel())], names=["cell", "node", "own"])


def _linked(cosine: float):
    """From sorted (cell, i, j, side, node, own, raw): links (a, b) of cells, spanning forests of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for g in groups(batches, ["cell", "i", "j"]):
            node, own = g["node"].to_numpy(), g["own"].to_numpy(zero_copy_only=False)
            u = units(g["raw"].to_pylist())
            near = (u @ u.T >= cosine) & (own[:, None] | own[None, :])
            if len(node) <= SMALL:
                a, b = np.nonzero(np.triu(near, 1))
            else:
                label = np.arange(len(node))
                np.fill_diagonal(near, True)
                while True:
                    new = np.where(near, label[None, :], len(label)).min(1)
                    new = np.minimum(new, new[new])
                    if (new == label).all():
                        break
                    label = new
                a, b = np.flatnonzero(label != np.arange(len(label))), label[label != np.arange(len(label))]
            done.append((node[a], node[b]))
            size += len(a)
            if size > 50_000:
                yield _pairs(done)
                done, size = [], 0
        if done:
            yield _pairs(done)

    return run


def _pairs(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in done]) for k in (0, 1))
    p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    p = p[p[:, 0] != p[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])


def _tally(x: np.ndarray, y: np.ndarray, times: np.ndarray, cosine: float) -> np.ndarray:
    """For each row of `x` the vectors that rows of `y` stand for and that it is linked with, a block at a time."""
    return np.concatenate([((x[k : k + BLOCK] @ y.T >= cosine) @ times.astype(np.float64)).astype(np.int64) for k in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])


def _counted(cosine: float):
    """From sorted (component, i, j, side, node, times, raw): (node, n), the vectors of the other chunk that each is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["component", "i", "j"]):
            node, times, side = g["node"].to_numpy(), g["times"].to_numpy(), g["side"].to_numpy()
            u = units(g["raw"].to_pylist())
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if g["i"][0] == g["j"][0]:
                out, counts = node, _tally(u, u, times, cosine) - times * (np.einsum("ij,ij->i", u, u) >= cosine)
            else:
                out = np.concatenate([node[left], node[right]])
                counts = np.concatenate([_tally(u[left], u[right], times[right], cosine), _tally(u[right], u[left], times[left], cosine)])
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(counts)], names=["node", "n"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each row of `vectors`.

    Vectors are linked if they were found to have a cosine of `cosine` or more;
    none below it is linked. A vector that is null, empty, all zero or has a
    null or non-finite component links with nothing, and so does a vector with
    those of another length. Equal vectors are linked with each other and
    compared once. Rows that share an id and their vectors count one by one.
    A row with a null id has a null component_id and is not kept; it does not
    take part. Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_v"), F.col(vector_col).alias("_e"))
    clean = materialize(rows.filter("_v is not null").mapInArrow(lean(_clean), "_v long, raw binary"), "lattice-clean")
    nodes = materialize(clean.filter("raw is not null").groupBy("raw").agg(F.min("_v").alias("node"), F.count("*").alias("times")), "lattice-nodes")
    placed = materialize(nodes.select("node", "raw").mapInArrow(lean(_hashed), "cell long, node long, own boolean"), "lattice-cells")
    met = placed.groupBy("cell").agg(F.count("*").alias("m"), F.max("own").alias("some")).filter("m > 1 and some").select("cell")
    meeting = deal(placed.join(met, "cell"), "cell", CHUNK).join(nodes.select("node", "raw"), "node")
    links = gathered(meeting, "cell").select("cell", "i", "j", "side", "node", "own", "raw").mapInArrow(lean(_linked(cosine)), "a long, b long")
    known = materialize(connected_components(links), "lattice-components")
    members = nodes.join(known, "node").select("component", "node", "times", "raw")
    widest = nodes.agg(F.max(F.octet_length("raw"))).first()[0] or 8
    chunk = max(1, min(COUNTED, COUNTED_BYTES // widest))
    counted = gathered(deal(members, "component", chunk), "component").select("component", "i", "j", "side", "node", "times", "raw").mapInArrow(lean(_counted(cosine)), "node long, n long")
    degree = counted.groupBy("node").agg(F.sum("n").alias("n"))
    found = nodes.join(known, "node", "left").join(degree, "node", "left").select("raw", F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"))
    result = clean.join(found, "raw", "left").select(F.col("_v").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "_v").alias("component_id"))
    nameless = rows.filter("_v is null").select(F.col("_v").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return result.union(nameless).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
