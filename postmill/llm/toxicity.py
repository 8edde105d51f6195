"""Toxicity: subword-bag embeddings, averaged, and a linear softmax, trained together in numpy.

A document is the bag of its words' character n-grams (three to five, with the
word's ends marked) and of its words, hashed to buckets. Each bucket has a
vector; the mean of a document's vectors goes into a linear softmax of two
classes. Vectors and softmax are trained jointly by Adam on TRAIN_DOCS labelled
documents a class at most. A misspelt word shares most of its n-grams with the
word, so it is scored like it without having been seen. After each step all
vectors are shortened by the same length, so that those of n-grams that tell
nothing become zero; else their noise drowns a few telling words in a long text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm import rolling
from postmill.llm.storage import bounded_batches, lean

BUCKETS, SIZE, GRAMS = 1 << 18, 4, (3, 4, 5)
TRAIN_DOCS, LEAST_DOCS, EPOCHS, STEP_DOCS, RATE, SHORTER, GAIN = 2000, 8, 50, 128, 0.03, 0.6, 300.0
#: Zero vectors that are averaged into every bag, so that a few n-grams of a short text do not decide alone.
BLANKS = 40
SLICE = 1 << 20
_STEPS = 1 << 20

_WORD: list[np.ndarray] = []


def _in_word() -> np.ndarray:
    if not _WORD:
        _WORD.append(np.array([chr(c).isalnum() for c in range(0x110000)]))
    return _WORD[0]


def buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """The buckets of each text's bag, repeats included."""
    c = np.frombuffer((" " + " ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t.lower()) + 1 for t in texts])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    word = _in_word()[c]
    c = np.where(word, c, np.uint64(32))
    before = np.concatenate([[0], np.cumsum(~word)])
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for n in GRAMS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        whole = before[n - 1 : n - 1 + m] == before[1 : m + 1]  # no blank inside
        at = np.flatnonzero(whole)
        h = rolling.windows(c, n, rolling.WORD_BASE)[at] + np.uint64(n)
        parts.append((at, h))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    parts.append((starts - 1, rolling.spans(c, starts, ends, rolling.WORD_BASE_2)))
    cuts = [(np.searchsorted(at, bounds), (h % np.uint64(BUCKETS)).astype(np.int32)) for at, h in parts]
    for k in range(len(texts)):
        yield np.concatenate([h[cut[k] : cut[k + 1]] for cut, h in cuts])


@dataclass
class Model:
    """What each bucket adds to the toxic logit, and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, bag: np.ndarray) -> float:
        z = self.bias + (float(self.weight[bag].sum(dtype=np.float64)) / (len(bag) + BLANKS))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, seed: int = 6) -> Model:
    """Fit vectors and softmax to bags given as (buckets, counts); `prior` is the share of toxic documents to be expected."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    rng = np.random.default_rng(seed)
    # Buckets of few documents would only fit noise; they keep a zero vector.
    seen = np.zeros(BUCKETS, np.int32)
    for b, _ in bags:
        seen[b] += 1  # a bag names a bucket once
    used = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [place[b] for b, _ in bags]
    shares = [(n / (n.sum() + BLANKS))[r >= 0].astype(np.float32) for r, (_, n) in zip(rows, bags, strict=True)]
    rows = [r[r >= 0] for r in rows]
    vectors = np.zeros((len(used), SIZE), np.float32)
    soft = rng.standard_normal((SIZE, 2)).astype(np.float32) * 0.5
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (vectors, soft, bias)]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        turn = rng.permutation(len(bags))
        for low in range(0, len(turn), STEP_DOCS):
            docs = [d for d in turn[low : low + STEP_DOCS] if len(rows[d])]
            if not docs:
                continue
            step += 1
            index, share = np.concatenate([rows[d] for d in docs]), np.concatenate([shares[d] for d in docs])
            n = np.array([len(rows[d]) for d in docs])
            mean = GAIN * np.add.reduceat(vectors[index] * share[:, None], np.cumsum(n) - n, axis=0)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            back = np.repeat(GAIN * (p @ soft.T), n, axis=0) * share[:, None]
            grad = np.stack([np.bincount(index, back[:, k], len(used)) for k in range(SIZE)], 1).astype(np.float32)
            for x, g, (m, v) in zip((vectors, soft, bias), (grad, mean.T @ p, p.sum(0)), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            vectors *= np.maximum(0, 1 - SHORTER * rate / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12))[:, None]
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = GAIN * vectors @ (soft[:, 1] - soft[:, 0])
    share = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(weight, float(bias[1] - bias[0] + shift))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (label, text): (label, buckets, counts)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
            pairs = [np.unique(x, return_counts=True) for x in buckets(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))], names=["label", "buckets", "counts"]
            )


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the labelled documents, about `train_docs` of each class at most, chosen by a hash of their ids."""
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1)").dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    sizes = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    if not sizes:
        return train([], np.zeros(0, np.int64), 0.0)
    part = F.create_map(*(F.lit(x) for y, n in sizes.items() for x in (y, min(_STEPS, -(-_STEPS * train_docs // n)))))
    chosen = marks.filter(F.pmod(F.xxhash64(F.lit(6), F.col("_id").cast("string")), F.lit(_STEPS)) < F.element_at(part, F.col("_y")))
    # About train_docs ids a class; the join broadcasts only these.
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    texts = own.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_y").alias("label"), "text")
    rows = texts.mapInArrow(lean(_bags), "label int, buckets array<int>, counts array<int>").toArrow()
    y = rows["label"].to_numpy()
    flat = []
    for name in ("buckets", "counts") if len(y) else ():
        lists = rows[name].combine_chunks()
        flat.append((lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])))
    bags = [tuple(x[e[k] : e[k + 1]] for x, e in flat) for k in range(len(y))]
    order = sorted(range(len(y)), key=lambda k: (int(y[k]), *(hashlib.blake2b(x).digest() for x in bags[k])))  # the same whatever the order of arrival
    toxic = sizes.get(1, 0) / sum(sizes.values())
    return train([bags[k] for k in order], y[order].astype(np.int64), toxic)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row, from 0 to 1, higher if toxic is likelier.

    A null, empty or wordless text gets the score of an empty bag, which is the
    prior. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in rolling.runs(SLICE, [len(t) for t in texts]):
                scores = [shared.value.score(bag) for bag in buckets(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), f"`{id_col}` {id_type}, score double")
