"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources get targets in words. Within a source a document's expected number of
copies falls with its length (DAMPING), so that the words of the mix come from
more documents; it never exceeds the most copies. Whole copies are certain; the
fraction that is left is the document's inclusion probability p, which
therefore differs from document to document.

Order sampling: a document with inclusion probability p gets the rank
(u / (1 - u)) / (p / (1 - p)), where u is a hash of its id and text; those of
smallest rank are taken until the source's words are used up, so the size of
the sample is fixed.

One pass writes a narrow row (source, length, u) for each document; all that
follows reads these. Ranks are binned on two levels, so what is sorted row by
row is one fine bin of each source; no source, however large, is ever sorted
or gathered as a whole, and no task gets more than BINS sums of one source.
The last pass over the documents reads a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.storage import materialize

#: What separates words: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Sources' weights by place, repeating; the part of all words that the mix takes; the most copies of a document.
WEIGHTS, SHARE, MOST_COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Expected copies fall with this power of the length, by doublings: of documents 16 times as long half as many are expected.
DAMPING = 0.25
#: Bins of the rank, and fine bins in each.
BINS = 128
#: The row per source is broadcast up to this many sources, joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words of a text as a long; none in a null text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(identity: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on id and text alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), identity.cast("string"), text.cast("string")), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def length_class(size: Column) -> Column:
    """How often a length can be halved: its binary digits, none for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """(src, source_size, target) from (src, words), a row for each source.

    Targets fill up like water: sources whose ceiling (most_copies times their
    words) lies below the common level get the ceiling, the others level times
    weight. Ordered by ceiling over weight, the capped ones come first, so the
    level follows from running sums. The windows run over a row per source.
    """
    by_name, whole = Window.orderBy(F.col("src").isNull(), "src"), Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), "src")
    levels = (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("words") * F.lit(float(most_copies)))
        .withColumn("total", F.sum("words").over(whole) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * (F.col("total") - F.col("caps_before")))
        .withColumn("level", (F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(whole))
    )
    return levels.select("src", F.col("words").alias("source_size"), F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def expected_copies(classes: DataFrame, aims: DataFrame, *, most_copies: float = MOST_COPIES, damping: float = DAMPING) -> DataFrame:
    """(src, source_size, target, copies, extra) of each source, from the words of its length classes (src, k, words).

    `copies` maps a class to its expected copies: the class's weight times a
    factor, most_copies at most, such that the expected words are the target.
    Shorter classes reach the most first, so the factor follows from running
    sums over the classes of a source. `extra` is what whole copies leave over.
    """
    most = F.lit(float(most_copies))
    short_first = Window.partitionBy("src").orderBy("k")
    before, onward, whole = short_first.rowsBetween(Window.unboundedPreceding, -1), short_first.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy("src")
    aim = aims.select(F.col("src").alias("s"), "source_size", "target")
    solved = (
        classes.join(aim, _same(F.col("src"), F.col("s")))
        .withColumn("w", F.pow(F.lit(2.0), -damping * F.col("k")))
        .withColumn("full", F.col("w") * (F.col("target") - F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0.0))) >= most * F.sum(F.col("words") * F.col("w")).over(onward))
        .withColumn("spare", F.col("target") - F.sum(F.when(F.col("full"), F.col("words") * most).otherwise(0.0)).over(whole))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("words") * F.col("w")).otherwise(0.0)).over(whole))
        .withColumn("e", F.when(F.col("full"), most).otherwise(F.least(most, F.greatest(F.lit(0.0), F.round(F.coalesce(F.try_divide("spare", "open"), F.lit(0.0)) * F.col("w"), 12)))))
    )
    rest = F.greatest(F.first("target") - F.sum(F.floor("e") * F.col("words")), F.lit(0.0))
    return solved.groupBy("src").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.map_from_entries(F.collect_list(F.struct("k", "e"))).alias("copies"), rest.alias("extra"))


def rank(u: Column, p: Column) -> Column:
    """The Pareto rank q = (u / (1 - u)) / (p / (1 - p)) in the form q / (1 + q), which lies between 0 and 1; 1 if p is 0."""
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u))).otherwise(1.0)


def _chance(e: Column, most_copies: float) -> Column:
    """The inclusion probability of one copy more than the whole ones."""
    return F.when(F.floor(e) + 1 <= most_copies, e - F.floor(e)).otherwise(0.0)


def _sized(rows: DataFrame) -> tuple[bool, DataFrame]:
    small = rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return small, F.broadcast(rows) if small else rows


def _end(rows: DataFrame, name: str) -> DataFrame:
    """(s, NAME, before) of the bin of each source in which `left` words run out, from rows (src, left, bin, size)."""
    sums = rows.groupBy("src", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    gone = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("before", gone).filter(F.col("before") <= F.col("left")).groupBy("src").agg(F.max(F.struct("bin", "before")).alias("x"))
    return last.select(F.col("src").alias("s"), F.col("x.bin").alias(name), F.col("x.before").alias(f"{name}_before"))


def ends(drawn: DataFrame) -> DataFrame:
    """Where the order of each source ends: (s, coarse, fine, last, tied, of_tied) from rows (src, extra, v, size, key).

    Documents of a smaller rank than `last` are taken; of the `tied` rows that
    bear it, equal ones, `of_tied` are.
    """
    rows = drawn.withColumns({"b1": F.floor(F.col("v") * BINS).cast("int"), "b2": F.pmod(F.floor(F.col("v") * (BINS * BINS)), F.lit(BINS)).cast("int")})
    first = _end(rows.select("src", F.col("extra").alias("left"), F.col("b1").alias("bin"), "size"), "coarse")
    within = rows.join(_sized(materialize(first, "mix-coarse"))[1], _same(F.col("src"), F.col("s")) & (F.col("b1") == F.col("coarse"))).drop("s").withColumn("left", F.col("extra") - F.col("coarse_before"))
    second = _end(within.select("src", "left", F.col("b2").alias("bin"), "size"), "fine")
    edge = within.join(_sized(materialize(second, "mix-fine"))[1], _same(F.col("src"), F.col("s")) & (F.col("b2") == F.col("fine"))).drop("s").withColumn("left", F.col("left") - F.col("fine_before"))
    keys = edge.groupBy("src", "key").agg(F.count("*").alias("tied"), F.first("size").alias("size"), F.first("left").alias("left"), F.first("coarse").alias("coarse"), F.first("fine").alias("fine"))
    before = F.coalesce(F.sum(F.col("tied") * F.col("size")).over(Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.floor((F.col("left") - before) / F.greatest("size", F.lit(1)) + 0.5)
    taken = keys.withColumn("of_tied", F.least(F.col("tied"), F.greatest(fits, F.lit(0))))
    found = F.max(F.when(F.col("of_tied") > 0, F.struct("key", "tied", "of_tied"))).alias("x")
    return taken.groupBy("src", "coarse", "fine").agg(found).select(F.col("src").alias("s"), "coarse", "fine", F.col("x.key").alias("last"), F.col("x.tied").alias("tied"), F.col("x.of_tied").alias("of_tied"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20,
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, damping: float = DAMPING,
) -> DataFrame:
    """All columns of `docs`, whatever their names, and a struct `_mix` of size, source_size, target and copies.

    Sources stand in code point order, null last; `weights` repeat over them.
    `copies` is how often the mix takes the document: the whole copies that its
    length and source are due, and one more for those that order sampling
    selects. The document at whose middle a source's words run out is the last.

    A null text has no words; documents without words get target shares like
    any other and add nothing. Rows of equal id and text have equal ranks; if
    the words run out between them, as many of them as fit are taken, so the
    result, as a set of rows, is the same in each run. An empty table gives an
    empty one. A column `_mix` of `docs` is replaced.
    """
    columns = [c for c in docs.columns if c != "_mix"]
    identity, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    key = lambda v: F.struct(v.alias("v"), identity.cast("string").alias("id"), F.xxhash64(text).alias("h"))
    slim = docs.select(source.alias("src"), n_words(text).alias("size"), uniform(identity, text, seed).alias("u"), identity.cast("string").alias("id"), F.xxhash64(text).alias("h"))
    slim = materialize(slim.withColumn("k", length_class(F.col("size"))), "mix-sizes")
    classes = materialize(slim.groupBy("src", "k").agg(F.sum("size").alias("words")), "mix-classes")
    aims = targets(classes.groupBy("src").agg(F.sum("words").alias("words")), weights=weights, share=share, most_copies=most_copies)
    plan = materialize(expected_copies(classes, aims, most_copies=most_copies, damping=damping), "mix-plan")
    small, listed = _sized(plan.withColumnRenamed("src", "s"))
    p = _chance(F.element_at("copies", F.col("k")), most_copies)
    placed = slim.join(listed, _same(F.col("src"), F.col("s"))).withColumn("v", rank(F.col("u"), p)).filter(p > 0)
    edges = materialize(ends(placed.select("src", "extra", "v", "size", F.struct("v", "id", "h").alias("key"))), "mix-ends")

    told = materialize(plan.join(edges, _same(F.col("src"), F.col("s")), "left").drop("s").withColumnRenamed("src", "s"), "mix-told")
    # The conditions are always true. They keep the optimizer from moving filters on the result below the join, where
    # they would count the words again, in code too long to be compiled.
    once = lambda value: F.when(F.monotonically_increasing_id() >= 0, value)
    size = once(n_words(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), source.alias("src"), size.alias("size"), uniform(identity, text, seed).alias("u"), key(F.lit(0.0)).alias("key"))
    e = F.element_at("copies", length_class(F.col("size")))
    ranked = rows.join(F.broadcast(told) if small else told, _same(F.col("src"), F.col("s"))).withColumn("e", e).withColumn("v", rank(F.col("u"), _chance(F.col("e"), most_copies)))
    ranked = ranked.withColumn("key", F.struct("v", "key.id", "key.h"))
    cell = F.struct(F.floor(F.col("v") * BINS).cast("int").alias("a"), F.pmod(F.floor(F.col("v") * (BINS * BINS)), F.lit(BINS)).cast("int").alias("b"))
    edge = F.struct(F.col("coarse").alias("a"), F.col("fine").alias("b"))
    due = _chance(F.col("e"), most_copies) > 0
    plus = F.coalesce(due & ((cell < edge) | ((cell == edge) & (F.col("key") <= F.col("last")))), F.lit(False))
    ranked = ranked.withColumn("plus", plus.cast("long"))
    if told.filter("of_tied < tied").limit(1).count():  # equal rows of which a part is taken: they are numbered
        split = F.coalesce(F.col("plus") * (F.col("key") == F.col("last")).cast("long") * (F.col("of_tied") < F.col("tied")).cast("long"), F.lit(0)) > 0
        number = F.row_number().over(Window.partitionBy("s").orderBy("key"))
        ranked = ranked.filter(~split).unionByName(ranked.filter(split).withColumn("plus", (number <= F.col("of_tied")).cast("long")))
    taken = F.struct(F.col("size"), F.col("source_size"), F.col("target"), once(F.floor("e").cast("long") + F.col("plus")).alias("copies"))
    return ranked.select(*[F.col("row").getField(c).alias(c) for c in columns], taken.alias("_mix"))


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """The rows that the mix takes, a row for each copy, with the columns of the input alone."""
    columns = [c for c in mixed.columns if c != "_mix"]
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int"))).alias("copy")
    return mixed.filter(F.col("_mix.copies") > 0).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), copies).select(*[F.col("row").getField(c).alias(c) for c in columns])
