"""Very long texts, repeated rows, ties and columns with clashing names, against brute force."""

import base64
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import near, sha, statistics, substring, suffixes, targets
from postmill.llm import bpe, language_id, lattice, license_passages, license_scan, minhash_forest, mixing, queries, quality_rules, storage, substring_dedup, suffix_family, toxicity

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
LONG = 1 << 20


@pytest.fixture(scope="module")
def long_rows():
    r = random.Random(31)
    words = [a + b + c for a in "ba ce di fo gu".split() for b in "l m n r s".split() for c in "a e i o".split()]
    passage = " ".join(r.choice(words) for _ in range(120))
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    big = text(LONG // 5 + 1) + " " + passage + "\n" + text(1000)
    rows = [(1, big), (2, text(300)), (3, passage + " tail"), (4, "head " + passage), (5, big), (6, None), (7, ""), (8, text(200)), (8, text(200))]
    assert len(big) > LONG
    return rows


def frame(spark, rows, extra=""):
    return spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string").repartition(3)


def test_long_texts_substrings(spark, long_rows):
    got = substring_dedup.remove_repeats(frame(spark, long_rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted(map(tuple, got.collect())) == sorted(substring(long_rows, 50))


def test_long_texts_suffixes(spark, long_rows, monkeypatch):
    monkeypatch.setattr(suffix_family, "SLICE", 300_000)
    got = suffix_family.remove_repeats(frame(spark, long_rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == sorted(suffixes(long_rows, 400))


def test_long_texts_near(spark, long_rows):
    rows = [x for x in long_rows if x[0] != 8]
    got = minhash_forest.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(near(rows))


def test_long_texts_statistics_and_repeated_rows(spark, long_rows):
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    got = quality_rules.judge(frame(spark, long_rows), labels).select("doc_id", "text", "_rules.*").collect()
    assert len(got) == len(long_rows)
    for x in got:
        assert tuple(x[2:7]) == statistics(x.text)
    assert got and len({x.score for x in got if x.doc_id in (1, 5)}) == 1


def test_long_texts_learned(spark, long_rows):
    docs = frame(spark, long_rows * 2)
    known = language_id.profiles(docs, lang_col="lang", id_col="doc_id", text_col="text")
    assert {(x.lang_pred, x.n) for x in language_id.identify(docs, known).groupBy("lang_pred").agg(F.count("*").alias("n")).collect()} == {("en", 14), ("und", 4)}
    model = toxicity.fit(docs, spark.createDataFrame([(2, 0), (3, 1)], "doc_id long, toxic int"))
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == 2 * len(long_rows) and all(0 <= x.score <= 1 for x in scores) and len({x.score for x in scores if x.doc_id in (1, 5)}) == 1


def test_long_words_are_encoded_as_a_whole(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    engine = bpe.BpeEngine(bpe.read_ranks(path), P.PATTERN)
    r = random.Random(32)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(of) for _ in range(n))
    words = [letters(n) for n in (63, 64, 65, 127, 128, 129, 20_000)] + ["abc" * 5000, "tionabc" * 3000, "x" * 20_000, letters(9000, "aab"), letters(3000, "日本語é"), "=-" * 5000]
    words += [letters(r.randrange(1, 400), r.choice(["ab", "etaoin", "lll1m"])) for _ in range(200)]
    assert all(a.tolist() == enc.encode_ordinary(w) for a, w in zip(engine.encode(words), words))
    assert [x.decode() for x in engine.decode(engine.encode(words))] == words
    engine.close()


def test_licences_of_long_texts_and_repeated_rows(spark, long_rows):
    docs = frame(spark, [(1, long_rows[0][1] + "\nReleased under the MIT License.\n"), (2, "MIT License"), (2, "MIT License")])
    assert [(x.doc_id, x.unit, x.license) for x in license_scan.scan(docs).collect()] == [(1, 3, "MIT")]
    assert sorted((x.doc_id, x.unit) for x in license_passages.passages(docs).collect()) == [(2, 1), (2, 1)]


def test_vectors_with_ties(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal(24)
    up = np.zeros(24)
    up[0] = 1.0
    edge = np.zeros(24)
    edge[0], edge[1] = 0.95, math.sqrt(1 - 0.95**2)
    rows = [(k, v.tolist()) for k, v in [(9, base), (2, base), (5, base), (5, base), (7, 3 * base), (20, up), (21, edge)]]
    got = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = int(float(np.dot(up, edge / np.linalg.norm(edge))) >= 0.95)
    assert got == {(9, 4, 2, False), (2, 4, 2, True), (5, 4, 2, False), (7, 4, 2, False), (20, linked, 20, True), (21, linked, 21 - linked, not linked)}


CLASH = ["_words", "_stats", "_ratio", "_score", "_trusted", "_u", "_u_bin", "_size", "_plus", "_src", "_copies", "_copy", "_d", "_gone", "row", "d", "s", "key", "size", "words", "text2", "stats", "target", "a.b"]


def test_columns_of_any_name_survive(spark):
    r = random.Random(33)
    rows = [(k, " ".join(r.choice(["elm", "oak", "ash"]) for _ in range(60)), f"s{k % 3}", *range(len(CLASH))) for k in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASH])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (quality_rules.judge(docs, labels).drop("_rules"), mixing.mix(docs).drop("_mix"), minhash_forest.one_of_each(docs)):
        assert out.columns == docs.columns
        assert {tuple(x) for x in out.collect()} <= {tuple(x) for x in rows} and out.count() > 0
    assert mixing.mixed_rows(mixing.mix(docs)).columns == docs.columns


def test_a_score_at_the_threshold_stays(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60))) for k in range(3)], "doc_id long, text string")
    got = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int"), threshold=0.0).select("_rules.score", "_rules.kept").collect()
    assert [tuple(x) for x in got] == [(0.0, True)] * 3


def test_order_sampling_by_brute_force(spark):
    r = random.Random(34)
    rows = [(k, " ".join("w" * r.randrange(1, 4) for _ in range(int(2 ** r.uniform(0, 9)))), r.choice(["a", "b", "c", None])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {x.doc_id: x.u for x in docs.select("doc_id", mixing.uniform(F.col("doc_id"), F.col("text"), 20).alias("u")).collect()}
    size = {k: len(t.split()) for k, t, _ in rows}
    of: dict = {}
    for k, _, s in rows:
        of.setdefault(s, []).append(k)
    want = targets({s: sum(size[k] for k in ks) for s, ks in of.items()})
    expected = {}
    for s, ks in of.items():
        weight = {k: 2.0 ** (-mixing.DAMPING * size[k].bit_length()) for k in ks}
        low, high = 0.0, 1e9  # the factor by bisection
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(size[k] * min(2.0, mid * weight[k]) for k in ks) < want[s] else (low, mid)
        e = {k: round(min(2.0, high * weight[k]), 9) for k in ks}
        p = {k: e[k] - math.floor(e[k]) for k in ks}
        left = want[s] - sum(math.floor(e[k]) * size[k] for k in ks)
        for k in ks:
            expected[k] = math.floor(e[k])
        for k in sorted((k for k in ks if p[k] > 0), key=lambda k: (u[k] / (1 - u[k])) / (p[k] / (1 - p[k]))):
            if left < size[k] / 2:
                break
            expected[k] += 1
            left -= size[k]
    got = {x.doc_id: x.copies for x in mixing.mix(docs).select("doc_id", "_mix.copies").collect()}
    assert got == expected
    assert len({round(x, 3) for x in p.values()}) > 3  # inclusion odds differ within a source


def test_equal_rows_are_taken_in_part(spark):
    docs = spark.createDataFrame([(None, "w " * 10, "a")] * 40 + [(1, "w " * 4000, "b")], "doc_id long, text string, source string")
    m = [x for x in mixing.mix(docs, weights=(1.0, 9.0), share=0.05).select("source", "_mix.*").collect() if x.source == "a"]
    assert len(m) == 40 and abs(sum(x.copies * x["size"] for x in m) - m[0].target) <= 10 and 0 < sum(x.copies for x in m) < 40


def test_out_of_place_distance_by_brute_force(spark):
    r = random.Random(35)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 60)))
    rows = [(k, make("abcde éß" if k % 2 else "defgh'1"), "x" if k % 2 else "y") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def counted(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        n = Counter()
        for w in words:
            n.update(w)
            n.update((" " + w + " ")[k : k + 2] for k in range(len(w) + 1))
            n.update((" " + w + " ")[k : k + 3] for k in range(len(w)))
        return n

    number = lambda g: [0, ord(g[0]), 0, 0][len(g)] if len(g) == 1 else (ord(g[0]) << 21 | ord(g[1])) if len(g) == 2 else ((ord(g[0]) << 21 | ord(g[1])) << 21) | ord(g[2])
    ranked = lambda n: sorted(n, key=lambda g: (-n[g], number(g)))[: language_id.PROFILE]
    known = {lang: ranked(sum((counted(t) for _, t, x in rows if x == lang), Counter())) for lang in "xy"}
    assert language_id.profiles(docs, lang_col="lang", id_col="doc_id", text_col="text") == {k: [number(g) for g in v] for k, v in known.items()}
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, {k: [number(g) for g in v] for k, v in known.items()}).collect()}
    for k, t, _ in rows:
        own = ranked(counted(t))
        far = {lang: sum(abs(known[lang].index(g) - i) if g in known[lang] else language_id.PROFILE for i, g in enumerate(own)) for lang in "xy"}
        best = min(sorted(far), key=far.get)
        assert got[k][0] == best and abs(got[k][1] - (1 - far[best] / (language_id.PROFILE * len(own)))) < 1e-9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{data}/labels.parquet").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {(x.toxic, x.predicted): x["count"] for x in queries.op6_toxicity(spark, data).filter("held_out").join(marks, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):
            return False

    class Context:
        master, applicationId = "spark://host:7077", "x"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Option)})

    with pytest.raises(RuntimeError):
        storage.scratch_root(type("Session", (), {"conf": Conf(), "sparkContext": Context})())
