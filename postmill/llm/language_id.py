"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, most
frequent first. A document's most frequent n-grams are ranked alike, and its
distance to a language is how far out of place they are there in sum; the
nearest language wins.

N-grams are of one to three characters of lower-cased words with a blank on
either side; anything that is not a letter is a blank.

Profiles are counted over at most TRAIN_DOCS labelled documents a language
(chosen by a hash of their ids, about that many), so what the driver receives
is PROFILE rows a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm import rolling
from postmill.llm.storage import bounded_batches, lean

PROFILE, TRAIN_DOCS = 400, 2000
UNDETERMINED = "und"
SLICE = 1 << 20
_STEPS = 1 << 20

_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text as numbers, and their counts; no number stands for two n-grams."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _is_letter()[c]
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank after each word
    keep[0] = True
    c, letter = c[keep], letter[keep]
    two = (c[:-1] << 21) | c[1:]
    inner = letter[:-1] | letter[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate([c[letter], two[inner], three[letter[1:-1]]]), return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first; ties by number."""
    g, n = grams(text)
    if len(g) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= least], n[n >= least]
    return g[np.argsort(-n, kind="stable")][:size]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text): (lang, gram, n), summed within a batch."""
    for batch in batches:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text or ""))
        for lang, parts in by.items():
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def profiles(labelled: DataFrame, *, lang_col: str, id_col: str, text_col: str, size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """The profile of each language of the labelled rows."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row per language
    if not sizes:
        return {}
    part = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(_STEPS, -(-_STEPS * train_docs // n)))))
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(7), F.col(id_col).cast("string")), F.lit(_STEPS)) < F.element_at(part, F.col(lang_col)))
    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in first.collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: [g for _, g in sorted(found[lang])] for lang in sorted(found)}


def identify(docs: DataFrame, known: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score) of each row: the nearest profile, and how near it is, from 0 (nothing in common) to 1 (in place throughout).

    A text that is null or has no letter is `und` with score 0, and so is every
    text if there are no profiles. Ties go to the language that is first by
    code point. Repeated rows give repeated results; other columns are ignored;
    an empty table gives an empty one.
    """
    langs = sorted(known)
    all_grams = np.unique(np.array([g for x in langs for g in known[x]], np.int64))
    place = np.full((len(all_grams) + 1, len(langs)), size, np.int64)  # the last row: n-grams of no profile
    for k, lang in enumerate(langs):
        place[np.searchsorted(all_grams, np.array(known[lang], np.int64)), k] = np.arange(len(known[lang]))
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, all_grams, place))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, all_grams, place = model.value
        for batch in batches:
            texts = batch.column(1)
            lengths = texts.cast(pa.binary()).fill_null(b"").to_pylist()
            for a, b in rolling.runs(SLICE, [len(t) for t in lengths]):
                pred, score = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    own = ranked(text or "", size)
                    if not len(own) or not langs:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    at = np.searchsorted(all_grams, own)
                    at[at == len(all_grams)] = 0
                    at = np.where(all_grams[at] == own, at, len(all_grams))
                    there = place[at]
                    far = np.where(there == size, size, np.abs(there - np.arange(len(own))[:, None])).sum(0)
                    k = int(far.argmin())
                    pred.append(langs[k])
                    score.append(1.0 - float(far[k]) / (size * len(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(lean(run), f"`{id_col}` {id_type}, lang_pred string, score double")


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(id_column.cast("string").cast("binary")) % folds
