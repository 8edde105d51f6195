"""MinHash near-dedup with an LSH forest.

Documents with equal shingle sets are one node. A node's signature is TREES
paths of DEPTH minima. Each tree is a sorted order of the paths; nodes that
stand near each other in one share a long prefix.

Candidates come from one scan of each order. A region is a run of equal
prefixes. Regions of up to REGION nodes give all their pairs at the shallowest
depth at which they are that small, so recall is that of one minimum wherever
the data are sparse; larger regions are split by the next minimum, and give
the neighbours in the order besides. Where even whole paths are shared by more,
each node gets the next few in the order and the first of the region, and the
region's members are kept: once components are known, members outside the
region's largest component are compared with all of the others, chunks of
strays with chunks of members, so that what is handed on are links, not pairs,
and a member is copied only once for each chunk of strays. The members of a run of
whole paths that touches the end of a task's range are kept likewise, as the
run may go on in the next task.

So two nodes that share a whole path in any tree are compared, however crowded
the data are around them. TREES and DEPTH are such that a pair of similarity
PERCENT shares none with a probability of under 1e-6.

Links are confirmed on whole shingle sets. First the likeliest and the smallest
partner of each node are confirmed; of the other candidates only those that
would join two components have to be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm import rolling
from postmill.llm.components import connected_components
from postmill.llm.dealing import deal_strays, gathered, groups
from postmill.llm.storage import lean, materialize

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, REGION, NEXT, CHUNK = 38, 4, 8, 3, 2048
#: Bits of the one-bit sketch that prunes candidates, and the least equal ones: a pair of 75 % has fewer with a probability of under 1e-7.
SKETCH_BITS, LEAST_EQUAL = 128, 90
SLICE = 1 << 19
#: Ids of rows without one: from here on.
UNNAMED = (1 << 63) - 1 - (1 << 40)
#: Nodes whose sets are fetched by a broadcast of their names, at most; beyond, by a shuffle.
BROADCAST_NODES = 1_000_000


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return rolling.mix(i * np.uint64(rolling.WORD_BASE)) | np.uint64(1), rolling.mix(i * np.uint64(rolling.WORD_BASE_2))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text, A-Z lower-cased."""
    buf, at = rolling.joined([t.lower() for t in texts])
    starts, ends = rolling.word_spans(buf)
    words, first = rolling.word_hashes(buf, starts, ends), np.searchsorted(starts, at)
    grams = rolling.windows(words, shingle, rolling.WORD_BASE)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(rolling.spans(words[a:b], np.array([0]), np.array([b - a]), rolling.WORD_BASE))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(shingle: int):
    a, b = _constants(TREES * DEPTH + SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in rolling.runs(SLICE, [len(t) for t in texts]):
                sets = shingle_sets(texts[low:high], shingle)
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                flat, at = np.concatenate([np.zeros(0, np.uint64), *sets]), (np.cumsum(n) - n)[some]
                sig = np.zeros((len(n), len(a)), np.uint32)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    for j in range(len(a)):
                        sig[some, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), at)
                    s1[some] = np.add.reduceat(flat, at)
                    s2[some] = np.add.reduceat(rolling.mix(flat + np.uint64(1)), at)
                bits = np.packbits((sig[:, TREES * DEPTH :] & 1).astype(bool), axis=1).view(np.int64)
                paths = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(sig[:, : TREES * DEPTH]).view(np.int32).ravel()), TREES * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), paths.cast(pa.list_(pa.int32())), pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1]))],
                    names=["_d", "n", "s1", "s2", "sig", "k1", "k2"],
                )

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (t, v1..vDEPTH, node, n, k1, k2) of one range: candidate pairs (a, b, equal), and (a, null, region) of members of dense regions."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    col = {k: table[k].to_numpy() for k in table.column_names}
    pairs: list[np.ndarray] = []
    differ = np.cumsum(np.stack([col["t"][1:] != col["t"][:-1], *(col[f"v{k}"][1:] != col[f"v{k}"][:-1] for k in range(1, DEPTH + 1))]), axis=0) > 0
    rows = np.arange(len(col["t"]))
    dense = np.zeros(0, np.int64)
    region_of = np.zeros(0, np.int64)
    for depth in range(1, DEPTH + 1):  # rows: those in regions that are still too large
        if not len(rows):
            break
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(rows) > 1) | differ[depth, rows[1:] - 1]
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(rows)]]))
        for m in range(2, REGION + 1):
            at = rows[first[size == m]]
            i, j = np.triu_indices(m, 1)
            if len(at):
                pairs.append(np.stack([(at[:, None] + i).ravel(), (at[:, None] + j).ravel()]))
        big = np.repeat(size > REGION, size)
        region = np.repeat(np.arange(len(first)), size)[big]
        rows = rows[big]
        steps = range(1, NEXT + 1) if depth == DEPTH else (1,)
        for s in steps:
            same = region[s:] == region[:-s]
            pairs.append(np.stack([rows[:-s][same], rows[s:][same]]))
        if depth == DEPTH:
            dense, region_of = rows, np.repeat(rows[np.flatnonzero(np.diff(region, prepend=-1))], np.bincount(region)[np.unique(region)]) if len(rows) else rows
            pairs.append(np.stack([region_of, dense]))
    turns = np.flatnonzero(differ[DEPTH])
    low, high = (turns[0] + 1, turns[-1] + 1) if len(turns) else (len(col["t"]), 0)
    dense = np.union1d(dense, np.concatenate([np.arange(low), np.arange(high, len(col["t"]))]))
    i, j = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    node, n = col["node"], col["n"]
    equal = SKETCH_BITS - sum(np.bitwise_count((col[k][i] ^ col[k][j]).view(np.uint64)).astype(np.int64) for k in ("k1", "k2"))
    good = (node[i] != node[j]) & (equal >= LEAST_EQUAL) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
    i, j, equal = i[good], j[good], equal[good]
    found = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), equal], 1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1])), pa.array(np.ascontiguousarray(found[:, 2]))], names=["a", "b", "x"])
    if len(dense):
        name = col["t"].astype(np.uint64)
        for k in range(1, DEPTH + 1):
            name = rolling.mix(name * np.uint64(31) + col[f"v{k}"].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(node[dense]), pa.nulls(len(dense), pa.int64()), pa.array(name[dense].view(np.int64))], names=["a", "b", "x"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        keep = []
        for k in range(batch.num_rows):
            x, y = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (a, b))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in rolling.runs(SLICE, [len(t) for t in texts]):
                sets = [s.tobytes() for s in shingle_sets(texts[low:high], shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _stray_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (region, i, j, node, component, own, shingles): a link of each stray (own) to every other component that it has one with."""
    for g in groups(batches, ["region", "i", "j"]):
        node, of, own = g["node"].to_numpy(), g["component"].to_numpy(), g["own"].to_numpy(zero_copy_only=False)
        strays, member = np.flatnonzero(own), np.flatnonzero(~own)
        if not len(strays) or not len(member):
            continue
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
        known, flat = np.unique(np.concatenate([sets[k] for k in member]), return_inverse=True)
        n = np.array([len(sets[k]) for k in member])
        at = np.cumsum(n) - n
        mark = np.zeros(len(known), np.int32)
        found: set[tuple[int, int]] = set()
        for k in strays:
            place = np.searchsorted(known, sets[k])
            mine = place[(place < len(known)) & (known[np.minimum(place, len(known) - 1)] == sets[k])]
            mark[mine] = 1
            both = np.add.reduceat(mark[flat], at)
            mark[mine] = 0
            other = member[(100 * both >= PERCENT * (n + len(sets[k]) - both)) & (of[member] != of[k])]
            for x in other[np.unique(of[other], return_index=True)[1]]:
                found.add((min(int(node[k]), int(node[x])), max(int(node[k]), int(node[x]))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unnamed = F.lit(UNNAMED) + F.pmod(F.xxhash64(text), F.lit(1 << 40))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("_d"), text.alias("_text"))


def _same_component(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """`pairs` with the components ca and cb of their ends; a node without links is its own."""
    side = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept, _d, _component), a row for each row of `docs`.

    Texts are linked if their sets of word shingles have a Jaccard similarity
    of PERCENT or more; component_id is the smallest id reachable, and `kept`
    marks the row that bears it. A null, empty or wordless text has an empty
    set and is linked with nothing. Rows that share an id count as one
    document. A row without an id takes part in links under a name made from
    its text (`_d`); its component_id is the smallest id in its component, null
    if there is none, and it is not kept unless its component has no ids and no
    smaller name. Other columns are ignored; an empty table gives an empty one.
    """
    keyed = _keyed(docs, id_col, text_col)
    signed = materialize(keyed.mapInArrow(lean(_signatures(shingle)), "_d long, n long, s1 long, s2 long, sig array<int>, k1 long, k2 long"), "forest-signatures")
    whole = signed.filter("n > 0")
    # Of equal sets the smallest id stands for all.
    # Written, so that joins with it shuffle both sides and Spark can split a partition of a frequent set.
    names = materialize(whole.groupBy("s1", "s2", "n").agg(F.min("_d").alias("node")), "forest-names")
    nodes = whole.join(names, ["s1", "s2", "n"]).filter("_d = node").dropDuplicates(["s1", "s2", "n"])
    tree = F.col("t") * DEPTH
    order = ["t", *(f"v{k}" for k in range(1, DEPTH + 1)), "node"]
    paths = nodes.select("node", "n", "k1", "k2", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    paths = paths.select("t", *(F.get("sig", tree + (k - 1)).alias(f"v{k}") for k in range(1, DEPTH + 1)), "node", "n", "k1", "k2")
    scanned = materialize(paths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_scan), "a long, b long, x long"), "forest-candidates")
    pairs = scanned.filter("b is not null").groupBy("a", "b").agg(F.max("x").alias("x"))

    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(scanned.filter("b is null").select("a")).distinct(), "forest-wanted")
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    texts = keyed.join(F.broadcast(wanted) if few else wanted, F.col("_d") == F.col("node"), "left_semi").select("_d", "_text")
    sets = materialize(texts.mapInArrow(lean(_sets(shingle)), "node long, shingles binary"), "forest-sets")

    def confirm(p: DataFrame) -> DataFrame:
        of = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s{end}"))
        return materialize(p.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(_confirmed), "a long, b long").distinct(), "forest-links")

    either = pairs.select("a", "b", "x").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "x"))
    best = either.groupBy("a").agg(F.max(F.struct("x", "b")).alias("top"), F.min("b").alias("low")).select("a", F.explode(F.array("top.b", "low")).alias("b"))
    links = confirm(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = materialize(connected_components(links), "forest-components")
    rest = confirm(_same_component(pairs, known).filter("ca <> cb"))
    links = links.union(rest)
    if rest.limit(1).count():
        known = materialize(connected_components(links), "forest-components")
    members = scanned.filter("b is null").select(F.col("x").alias("region"), "a").distinct()
    placed = materialize(members.join(known.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a")), "forest-members")
    sums = placed.groupBy("region", "component").agg(F.count("*").alias("m")).groupBy("region").agg(F.max(F.struct("m", "component")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("many"))
    # Written, so that the join shuffles both sides and Spark can split a partition of a frequent region.
    mixed = materialize(sums.filter("parts > 1").select("region", F.col("main.component").alias("main"), "many", (F.col("many") - F.col("main.m")).alias("few")), "forest-mixed")
    strays = placed.join(mixed, "region").select("region", F.col("a").alias("node"), "component", "few", "many", (F.col("component") != F.col("main")).alias("astray"))
    met = gathered(deal_strays(strays, "region", CHUNK).join(sets, "node"), "region").select("region", "i", "j", "node", "component", "own", "shingles")
    more = materialize(met.mapInArrow(lean(_stray_links), "a long, b long").distinct(), "forest-links")
    if more.limit(1).count():
        known = materialize(connected_components(links.union(more)), "forest-components")

    ends = materialize(names.join(known, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("_component")), "forest-ends")
    placed = signed.select("_d", "n", "s1", "s2").join(ends, ["s1", "s2", "n"], "left").withColumn("_component", F.coalesce("_component", "_d"))
    named: Column = F.col("_d") < UNNAMED
    return placed.select(
        F.when(named, F.col("_d")).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_component") < UNNAMED, F.col("_component")).alias("component_id"), (F.col("_d") == F.col("_component")).alias("kept"), "_d", "_component"
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that :func:`near_duplicates` keeps, with all their columns, whatever their names; of rows that share an id, one.

    Rows without words are linked with nothing and stay, one for each id.
    """
    found = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col).select("_d", "kept"), "forest-verdicts")
    gone = found.filter("not kept").select(F.col("_d").alias("_gone")).distinct()
    twice = found.filter("kept").groupBy(F.col("_d").alias("_twice")).agg(F.count("*").alias("m")).filter("m > 1").select("_twice")

    def listed(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else ids

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(text), F.lit(1 << 40)))
    named = docs.select(name.alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    stay = named.join(listed(gone), F.col("d") == F.col("_gone"), "left_anti")
    if twice.limit(1).count():
        some = listed(twice)
        stay = stay.join(some, F.col("d") == F.col("_twice"), "left_anti").unionByName(stay.join(some, F.col("d") == F.col("_twice"), "left_semi").dropDuplicates(["d"]))
    return stay.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
