"""Quality rules, mixing, tokens, toxicity, languages and licences."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from brute import sha, statistics, targets
from postmill.llm import bpe, language_id, license_passages, license_scan, mixing, quality_rules, toxicity

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
TEXTS = [None, "", " \n ", "a b c", "a b c a b c", "x\nx\ny \ny\n\n", "one two three " * 30, "# * | é ß", "the end " * 3 + "of it", "lo la li lo la li lo"]


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, 0, 1.0) for k, t in enumerate(texts)], SCHEMA)


def labels(spark, good):
    return spark.createDataFrame([(i, 1, 0) for i in good] or [], "doc_id long, quality int, toxic int")


def test_statistics(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(60)]
    got = quality_rules.judge(frame(spark, texts), labels(spark, [])).select("doc_id", "_rules.*", "score").collect()
    for row in got:
        assert tuple(row[1:6]) == statistics(texts[row.doc_id])
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words) and row.kept == (not row.base_failed)


def test_quality_ratio_separates_and_filters(spark):
    r = random.Random(2)
    clean = [" ".join(r.choice("alder birch cedar maple rowan willow aspen hazel".split()) + r.choice(["", "s", "en"]) for _ in range(80)) for _ in range(40)]
    junk = [" ".join(f"{r.choice('qwxz')}{r.randrange(999)}!!" for _ in range(80)) for _ in range(40)]
    rows = quality_rules.judge(frame(spark, clean + junk), labels(spark, range(20)))
    kept = rows.filter("_rules.kept and not _rules.base_failed").select("doc_id", "score")
    ids = {x.doc_id for x in kept.collect()}
    assert set(range(40)) - ids == {x.doc_id for x in rows.filter("_rules.base_failed").collect() if x.doc_id < 40} and not ids & set(range(40, 80))


def test_all_labelled_good_documents_are_trusted(spark):
    good = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert quality_rules.trusted_ids(good.union(good).union(spark.sql("SELECT 40000L, 0"))).count() == 30_000


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(k, " ".join("w" for _ in range(r.randint(0, 30))), None if k % 7 == 0 else r.choice(["a", "b", "B", "é"]), "t") for k in range(600)] + [(None, None, "b", "t"), (3, "x y", "a", "t"), (3, "x y", "a", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _src string")
    m = F.col("_mix")
    out = mixing.mix(df.withColumnRenamed("_src", "size")).select("doc_id", "source", m["size"].alias("n"), m["source_size"].alias("all"), m["target"].alias("target"), m["copies"].alias("copies")).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    assert len(out) == len(rows)
    for x in out:
        assert x["all"] == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.copies <= 2
        taken[x.source] = taken.get(x.source, 0) + x.n * x.copies
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    again = mixing.mixed_rows(mixing.mix(df.withColumnRenamed("_src", "size").repartition(7)))
    assert again.count() == sum(x.copies for x in out) and again.columns == ["doc_id", "text", "source", "size"]


def test_bpe(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = TEXTS + ["<|endoftext|> don't  we'll", "日本語テキスト 🙂", "\0nul\0", "a" * 5000, "=-" * 900, "".join(r.choice("abcdeé ") for _ in range(3000)), "q" * 65 + "xyz" * 40]
    got = {x.doc_id: x for x in bpe.digests(bpe.encode_decode(frame(spark, texts), path, P.PATTERN)).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))


def test_languages(spark):
    r = random.Random(6)
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das ist nicht ein ich sie für".split()}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for k in range(80) for lang in ("en", "de")]
    docs = spark.createDataFrame([(i, t, lang) for i, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    known = language_id.profiles(docs, lang_col="lang", id_col="doc_id", text_col="text")
    odd = [(1000, None, None), (1001, "12 34 !", None), (1002, "", "en")]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs.union(spark.createDataFrame(odd, docs.schema)), known).collect()}
    assert all(got[i][0] == lang for i, (_, _, lang) in enumerate(rows)) and all(got[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert language_id.identify(docs, {}).select("lang_pred").distinct().first()[0] == "und"
    assert language_id.ranked("Aab aab", 3).tolist() == language_id.ranked("aab AAB", 3).tolist()


def test_toxicity(spark):
    r = random.Random(7)
    plain = "river stone cloud meadow lantern harbor willow copper".split()
    make = lambda bad: " ".join([r.choice(plain) for _ in range(40)] + ["grumblefoot"] * bad)
    docs = spark.createDataFrame([(i, make(3 if i % 3 == 0 else 0)) for i in range(300)] + [(900, "river grumblefooot stone meadow"), (901, "river stone meadow"), (902, None), (903, "!!")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    s = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert min(s[i] for i in range(0, 300, 3)) > 0.6 > 0.2 > max(s[i] for i in range(300) if i % 3)
    assert s[900] > 0.6 > s[901] and s[902] == s[903] and 0 <= s[902] <= 1
    assert toxicity.score(docs, toxicity.fit(docs, marks.filter("false"))).filter("score between 0 and 1").count() == docs.count()


def test_licences(spark):
    texts = TEXTS + ["intro\nReleased under the MIT License\nend", "Licensed under the Apache License, version 2.0", "licensed under cc by 4.0", "nothing here at all"]
    got = sorted((x.doc_id - len(TEXTS), x.unit, x.license) for x in license_scan.scan(frame(spark, texts)).collect())
    assert got == [(0, 2, "MIT"), (1, 1, "Apache-2.0"), (2, 1, "CC-BY-4.0")]
    whole = {"two": "first line of it\nsecond line of it"}
    assert [(x.unit, x.dice) for x in license_scan.scan(frame(spark, ["First line of it,\nsecond line of it!"]), whole).collect()] == [(0, 1.0)]
    assert license_scan.scan(frame(spark, texts), {}).count() == 0


def test_licence_passages(spark, tmp_path):
    from pathlib import Path

    from postmill.llm import queries

    full = lambda name: (Path(license_passages.__file__).parent / "licences" / f"{name}.txt").read_text()
    texts = ["code here\nThe MIT License (MIT)\n\nCopyright 2001 A. Body\n\n" + full("MIT") + "\nand more code", "some words\n" + full("BSD-3-Clause").replace("\n", "\r\n"), "x y z " * 50 + full("GPL-3.0").replace("\n", " ").replace("copyright", "copyrite", 3)]
    texts += ["One long line which says, released\nunder the MIT License, what it is.", "A long paragraph of prose that is, by the way, licensed under CC BY 4.0. It goes on and on after that.", "intro\nReleased under the MIT License\nend", "# " + full("MPL-2.0.header").replace("\n", "\n# "), "nothing", None]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((x.doc_id, x.unit, x.license) for x in queries.op2_license_scan(spark, str(tmp_path)).collect())
    assert got == [(0, 2, "MIT"), (0, 6, "MIT"), (1, 2, "BSD-3-Clause"), (2, 1, "GPL-3.0"), (3, 1, "MIT"), (4, 1, "CC-BY-4.0"), (5, 2, "MIT"), (6, 1, "MPL-2.0")]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert quality_rules.judge(empty, labels(spark, [])).count() == mixing.mix(empty).count() == license_scan.scan(empty).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels(spark, []))).count() == 0
    assert language_id.identify(empty, language_id.profiles(empty, lang_col="lang", id_col="doc_id", text_col="text")).count() == 0
    assert bpe.encode_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
