"""The deduplicating operators against brute force, with odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import components, near, substring, suffixes
from postmill.llm import components as cc
from postmill.llm import lattice, minhash_forest, rolling, substring_dedup, suffix_family

SCHEMA = "doc_id long, text string, source string, h long, _mix int"


def corpus(seed, n=40):
    r = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(60)]
    passage = [" ".join(r.choice(words) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [r.choice(passage) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, r.choice(["\n", " ", "  \t"]).join(parts)))
    base = rows[5][1].split(" ")
    for k in range(12):  # near copies
        copy = list(base)
        if copy:
            copy[r.randrange(len(copy))] = f"edit{k}"
        rows.append((200 + k, " ".join(copy)))
    rows += [(300, rows[7][1]), (301, rows[7][1]), (302, ""), (303, None), (304, " \n\t "), (305, "ab " * 200), (306, "a" * 700), (307, "é" * 300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, seed):
    rows = corpus(seed) + [(None, corpus(seed)[6][1]), (9, corpus(seed)[3][1]), (9, corpus(seed)[3][1])]
    got = substring_dedup.remove_repeats(frame(spark, rows), window=10, anchor=3)
    same(got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)), substring(rows, 10))


@pytest.mark.parametrize(("seed", "chunk"), [(1, 8192), (2, 8192), (3, 1), (4, 2)])
def test_suffixes(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(suffix_family, "CHUNK_SEGMENTS", chunk)
    monkeypatch.setattr(suffix_family, "BATCH", 7)
    rows = corpus(seed) + [(None, "x" * 100), (9, "y"), (9, "y")]
    got = suffix_family.remove_repeats(frame(spark, rows), match=60, gram=8, carry=["source", "h"])
    same(got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)), suffixes(rows, 60))
    assert got.select("carried.source").distinct().count() == 1


def test_suffix_pieces_and_long_text(monkeypatch):
    monkeypatch.setattr(suffix_family, "SLICE", 500)
    r = random.Random(3)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (2000, 0, 59, 60, 700)]
    buf, at = rolling.joined(texts)
    seen = []
    for x in suffix_family.samples(buf, at, 60, 8):
        for t, s, n in zip(x["text"], x["start"], x["n"]):
            seen += [(int(t), int(s) + k) for k in range(n)]
    assert sorted(seen) == [(t, k) for t, x in enumerate(texts) for k in range(len(x) - 59)]  # each string is in one segment


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    rows = corpus(seed, 60)
    got = minhash_forest.near_duplicates(frame(spark, rows))
    same(got.select("doc_id", "n_shingles", "component_id", "kept"), near(rows))


def test_near_dense_group(spark):
    r = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    same(minhash_forest.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept"), near(rows))


def test_near_pairs_in_a_crowd_of_no_links(spark):
    base = " ".join(f"t{k}" for k in range(152))
    tail = lambda i, start: " ".join([f"p{i}a p{i}b", *(f"u{start}x{k}" for k in range(24))])
    rows = [(i, f"{base} {tail(i // 2, i)}") for i in range(1000)]  # 148 shingles of 200 are shared by any two, 150 of 198 by the two of a pair
    got = minhash_forest.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    same(got, [(i, 174, i // 2 * 2, i % 2 == 0) for i in range(1000)])
    assert near(rows[:20]) == [(i, 174, i // 2 * 2, i % 2 == 0) for i in range(20)]


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(4, text), (2, text), (2, text), (None, text), (None, "alone by itself"), (7, None), (8, ""), (8, "")]
    left = minhash_forest.one_of_each(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "source", "h", "_mix"]
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, "alone by itself"), (2, text), (7, ""), (8, "")]


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in cc.connected_components(links).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
    assert cc.connected_components(links.filter("false")).count() == 0


def test_lattice(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 16)
    monkeypatch.setattr(lattice, "COUNTED", 24)
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 32))
    vectors = [*base, *(base[0] + 0.05 * r.standard_normal((60, 32))), *(base[1] + 0.22 * r.standard_normal((20, 32))), 2 * base[3], base[4], base[4], base[4]]
    rows = [(k * 2, [float(x) for x in v]) for k, v in enumerate(vectors)]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    linked = lambda a, b: float(a @ b) >= 0.95
    expected = [(i, sum(linked(units[i], u) for j, u in units.items() if j != i), c, c == i) for i, c in components(units, linked)]
    odd = [(1001, None), (1003, [0.0] * 32), (1005, [1.0, None] + [0.0] * 30), (1007, [float("nan")] * 32), (1009, []), (1011, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd] + [(None, [1.0] * 32, "x")], "vec_id long, embedding array<double>, cell string")
    same(lattice.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept"), expected + [(i, 0, i, True) for i, _ in odd] + [(None, 0, None, False)])


def test_e8_points():
    x = np.random.default_rng(1).uniform(-3, 3, (500, 8))
    p = lattice.decode(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all() and len(lattice.ROOTS) == 240
    near = ((x - p) ** 2).sum(1)
    assert (near <= 1 + 1e-9).all()
    assert all((((x - p - root) ** 2).sum(1) >= near - 1e-9).all() for root in lattice.ROOTS)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert substring_dedup.remove_repeats(empty).count() == suffix_family.remove_repeats(empty).count() == minhash_forest.near_duplicates(empty).count() == minhash_forest.one_of_each(empty).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
