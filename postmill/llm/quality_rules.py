"""Quality rules in DataFrame operations only: text statistics, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams: one of trusted
documents, one of the whole raw corpus, both smoothed. A document's score is
the mean log ratio over its n-grams, so length cancels out; one threshold then
decides every document alike.

An n-gram here is a word, a pair of neighbouring words, or the last three
characters of a word; the last kind carries marks and inflections that whole
words in an open vocabulary do not repeat often enough to count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, SYMBOLS, HAS_WORD = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", r"[^\x20\x09-\x0D]"
#: Hash buckets of n-grams, added to each bucket's count, least mean log ratio of a document that stays.
BUCKETS, SMOOTHING, THRESHOLD = 1 << 14, 1.0, -0.5
#: Base rules: least words, and the most per cent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Trusted ids are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_IDS = 500_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a whole text in order; none in a null text."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, from the sorted (hash, place) of all windows."""

    def covered(places: Column) -> Column:  # each window covers up to the next one, three words at most
        n = F.size(places)
        return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(3).cast("long"), lambda a, k: a + F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1)))

    def places_of(windows: Column) -> Column:
        same = lambda x, k: F.get(windows, k)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        repeated = _let(F.sort_array(placed), lambda w: _let(places_of(w), lambda p: F.when(F.size(p) > 1, covered(p)).otherwise(F.lit(0).cast("long"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, _let(hashes, counted)).otherwise(F.lit(0).cast("long"))


def statistics(text: Column, words: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text with these words."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(HAS_WORD))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
    )


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _buckets(word: Column, after: Column) -> list[Column]:
    """The buckets of a word, of its end, and of the pair that it makes with the word after it."""
    return [_bucket(word), _bucket(F.lit("end"), F.right(word, F.lit(3))), _bucket(word, F.coalesce(after, F.lit("")))]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, raw, trusted) from (text, good): n-grams of all texts, and of those marked good.

    One pass; what each task shuffles is a row per bucket at most.
    """
    words = F.when(F.monotonically_increasing_id() >= 0, words_of(F.col("text")))  # always true; see `judge`
    pairs = rows.select("good", words.alias("w")).select("good", F.explode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("after"))).alias("p"))
    grams = pairs.select("good", F.explode(F.array(*_buckets(F.col("p.word"), F.col("p.after")))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("trusted"))


def log_ratios(counts: DataFrame) -> list[float]:
    """The log ratio of each bucket from their counts, a list of BUCKETS numbers; all 0 without trusted or raw n-grams."""
    import math

    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # a row per bucket: bounded by BUCKETS whatever the corpus
        raw[row["bucket"]], trusted[row["bucket"]] = row["raw"], row["trusted"]
    if not (sum(raw) and sum(trusted)):
        return [0.0] * BUCKETS
    low = [math.log(sum(n) + SMOOTHING * BUCKETS) for n in (trusted, raw)]
    return [(math.log(a + SMOOTHING) - low[0]) - (math.log(b + SMOOTHING) - low[1]) for a, b in zip(trusted, raw, strict=True)]


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of all labelled good documents."""
    return labels.filter(F.col(quality_col) == 1).select(F.col(id_col).alias("_trusted")).dropna().distinct()


def _flagged(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id, text) with `good`: whether the id is trusted. Up to BROADCAST_IDS ids are broadcast; more meet the texts in a shuffle."""
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marks = F.broadcast(trusted) if few else trusted.hint("shuffle_hash")
    return rows.join(marks, rows["id"] == marks["_trusted"], "left").select("text", F.col("_trusted").isNotNull().alias("good"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs`, whatever their names, and a struct `_rules`: the statistics, base_failed, score and kept.

    Raw counts cover every document; the trusted counts cover the documents
    whose id `labels` marks as good, all of them. A null or empty text has no
    words and fails the base rules. A document without n-grams scores 0.
    Without trusted documents every score is 0. Repeated rows are judged alike,
    and count as often as they are there; a document of just `threshold` stays;
    an empty table gives an empty one. A column `_rules` of `docs` is replaced.
    """
    row = [c for c in docs.columns if c != "_rules"]
    text = F.col(f"`{text_col}`")
    ratios = log_ratios(bucket_counts(_flagged(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), trusted_ids(labels, id_col=id_col))))
    # One row of BUCKETS numbers, read as a scalar subquery: each task gets it once, and nothing is joined.
    table = docs.sparkSession.createDataFrame([(ratios,)], "ratio array<double>").scalar()
    # The condition is always true. It keeps the optimizer from moving filters below the words, which would split the
    # text again for each use.
    split = F.when(F.monotonically_increasing_id() >= 0, words_of(text))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), text.alias("text"), split.alias("words"), table.alias("ratio"))
    words, ratio, zero = F.col("words"), F.col("ratio"), F.lit(0.0)
    each = F.transform(words, lambda w, i: sum((F.get(ratio, b) for b in _buckets(w, F.get(words, i + 1))), zero))
    score = F.when(F.size(words) > 0, F.aggregate(each, zero, lambda a, b: a + b) / (3 * F.size(words))).otherwise(zero)
    judged = held.select("row", statistics(F.col("text"), words).alias("stats"), score.alias("score"))
    failed = base_failed(F.col("stats"))
    verdict = F.struct("stats.*", failed.alias("base_failed"), F.col("score").alias("score"), (~failed & (F.col("score") >= threshold)).alias("kept"))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in row], verdict.alias("_rules"))
