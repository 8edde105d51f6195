"""The pipeline's stages against brute force on one small corpus."""

import base64
import math
import random
from collections import Counter

import pytest

from brute import near, sha, statistics, targets
from postmill.llm import quality_rules as Q

xxhash = pytest.importorskip("xxhash")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
cp = pytest.importorskip("corpus_pipeline")
MASK = (1 << 64) - 1


def bucket(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode(), seed=seed & MASK).intdigest()
    return (seed - (1 << 64) if seed >> 63 else seed) % Q.BUCKETS


def grams(text):
    w = (text or "").split()
    out = [bucket(x) for x in w] + [bucket("end", x[-3:]) for x in w]
    return out + [bucket(x, w[k + 1] if k + 1 < len(w) else "") for k, x in enumerate(w)]


def kept_by_rules(rows, good):
    raw, trusted = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            trusted.update(grams(t))
    n = [math.log(sum(c.values()) + Q.BUCKETS) for c in (trusted, raw)]
    kept = {}
    for i, t in rows:
        words, _, _, _, repeated = statistics(t)
        g = grams(t)
        score = sum((math.log(trusted[b] + 1) - n[0]) - (math.log(raw[b] + 1) - n[1]) for b in g) / len(g) if g else 0.0
        kept[i] = words >= 50 and 100 * repeated <= 50 * words and score >= Q.THRESHOLD
    return kept


def cut(rows, match=cp.PASSAGE_BYTES):
    texts = [t.encode() for _, t in rows]
    n = Counter(t[k : k + match] for t in texts for k in range(len(t) - match + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - match + 1):
            if n[t[k : k + match]] > 1:
                gone[k : k + match] = b"\1" * match
        out.append((i, bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return out


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(11)
    words = [a + b for a in "al bir ced map row wil asp haz oak elm".split() for b in "en és or il um ow".split()]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(90)
    rows = [(i, prose(r.randint(60, 120))) for i in range(70)]
    rows += [(100 + i, f"{prose(60)}\n{passage}\n{prose(20)}") for i in range(6)]
    rows += [(200 + i, rows[i][1].replace(" ", f" x{i} ", 1)) for i in range(10)] + [(220 + i, rows[3][1]) for i in range(4)]
    rows += [(300 + i, " ".join(f"{r.choice('qwxz')}{r.randrange(999)}!!" for _ in range(70))) for i in range(15)]
    rows += [(400, None), (401, ""), (402, "short text")]
    docs = spark.createDataFrame([(i, t, "en", None if i % 9 == 0 else f"src{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (*range(40), 100, 101, 102)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stage = dict(cp.STAGES)

    docs = stage["quality_rules"](spark, docs, folder).cache()
    kept = kept_by_rules(rows, {*range(40), 100, 101, 102})
    left = [(i, t) for i, t in rows if kept[i]]
    assert docs.columns == columns and sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(left)
    assert 70 <= len(left) < 100

    docs = stage["minhash_near_dedup"](spark, docs, folder).cache()
    first = {i for i, _, c, k in near(left) if k}
    left = [(i, t) for i, t in left if i in first]
    assert docs.columns == columns and sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(left)

    docs = stage["suffix_array_dedup"](spark, docs, folder).cache()
    before, left = dict(left), cut(left)
    assert docs.columns == columns and sorted((x.doc_id, x.text) for x in docs.collect()) == sorted(left)
    assert any(len(t) < len(before[i]) for i, t in left) and all(x.n_chars == len(x.text) for x in docs.collect())

    mixed = stage["mix_sources"](spark, docs, folder).cache()
    source, text = {x.doc_id: x.source for x in docs.collect()}, dict(left)
    sizes, taken = Counter(), Counter()
    for i, t in left:
        sizes[source[i]] += len(t.split())
    copies = Counter(x.doc_id for x in mixed.collect())
    for i, k in copies.items():
        taken[source[i]] += k * len(text[i].split())
    want = targets(sizes)
    assert mixed.columns == columns and max(copies.values()) <= 2 and all(abs(taken[s] - want[s]) <= 120 for s in want)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stage["byte_bpe"](spark, mixed, folder).collect()
    assert Counter(x.doc_id for x in out) == copies
    for x in out:
        ids = enc.encode_ordinary(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text[x.doc_id].encode()))
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, out))


def test_replacement_characters_of_the_text_stay(spark):
    r = random.Random(12)
    passage = "".join(r.choice("abcdefé ") for _ in range(500))
    rows = [(1, f"one \ufffd\1b \1a \1 start {passage} end \ufffd1"), (2, f"two é\ufffdé{passage}è\ufffd\ufffd x"), (3, f"three \ufffd ê{passage}é four"), (4, "no passage \ufffd \1b \1")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = cp.substring_dedup(spark, docs, "").collect()
    assert sorted((x.doc_id, x.text) for x in got) == cut(rows) and all(x.n_chars == len(x.text) for x in got)
    assert [t.count("\ufffd") for _, t in cut(rows)] == [2, 3, 1, 1]
