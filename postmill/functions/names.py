"""Names of outputs: slugs, clean file names, targets and collision suffixes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions.rows import by_row
from postmill.functions.text import strip

MOST_SUFFIXES = 10_000


def slug(subject: str | None, fallback: str = "email") -> str:
    text = re.sub(r"^(?:\s*(?:re|fwd?)\s*:\s*)+", "", subject or "", flags=re.I).strip().lower()
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or fallback


def slugify(subject: Column) -> Column:
    """A file-name form of a subject; needs Unicode decomposition, hence a vectorised UDF."""
    return by_row(slug, "string")(subject)


def clean_filename(raw: Column) -> Column:
    """Native form of the attachment-name rule."""
    name = F.replace(strip(F.coalesce(raw, F.lit(""))), F.lit("\0"), F.lit(""))
    usable = F.filter(F.split(name, r"[\\/]+"), lambda p: ~p.isin("", ".", ".."))
    return F.when(name == "", "").otherwise(F.coalesce(F.get(usable, F.size(usable) - 1), F.lit("attachment")))


def output_target(source: Column, name: Column, output: Column) -> Column:
    """A sibling of the source if no output is given, the output itself if it is a .md file, else a file in it."""
    parent = F.regexp_replace(source, r"/[^/]*$", "")
    return F.when(output.isNull(), F.concat(parent, F.lit("/"), name, F.lit(".md"))).when(F.lower(output).endswith(".md"), output).otherwise(F.concat(output, F.lit("/"), name, F.lit(".md")))


def _root(name: Column) -> Column:
    """A name without the numbers at its end; only names with one root can get in each other's way."""
    return F.regexp_replace(name, r"(?:-\d+)+$", "")


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (folder, root, name, there, key) in order: (key, final); names that are there already keep them."""
    family, used, following = None, set(), {}
    for batch in batches:
        keys, finals = [], []
        for folder, root, name, there, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (folder, root) != family:
                family, used, following = (folder, root), set(), {}
            if there:
                used.add(name)
                continue
            k, final = following.get(name, 1), None
            while k <= MOST_SUFFIXES and final is None:
                candidate = name if k == 1 else f"{name}-{k}"
                final = None if candidate in used else candidate
                k += 1
            following[name] = k
            used.add(final)
            keys.append(key)
            finals.append(final)
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(finals, pa.string())], names=["key", "final"])


def numbered(df: DataFrame, *, folder: str, name: str, order: str, into: str = "final_name", existing: DataFrame | None = None) -> DataFrame:
    """`df` with names that are unique in their folder, given out in the order of `order`, which must be unique.

    Each row gets its name if it is free, else the first free one of -2, -3, up
    to MOST_SUFFIXES, null beyond. A name may look numbered already and be in
    the way of another. `existing` (with the columns `folder` and `name`) lists
    names that are taken. Where all names of a root are the same and none is
    taken, ranks tell the numbers; only the other families are gone through in
    turn, as a sorted stream of names.
    """
    narrow = df.select(F.col(folder).alias("folder"), F.col(name).alias("name"), F.lit(False).alias("there"), F.col(order).alias("key"))
    if existing is not None:
        taken = existing.select(F.col(folder).alias("folder"), F.col(name).alias("name"), F.lit(True).alias("there"), F.lit(None).cast(df.schema[order].dataType).alias("key"))
        narrow = narrow.unionByName(taken)
    narrow = narrow.withColumn("root", _root(F.col("name")))
    family = narrow.groupBy("folder", "root").agg((F.min("name") == F.max("name")).alias("alike"), F.max("there").alias("some"))
    marked = narrow.join(family.select(F.col("folder").alias("f"), F.col("root").alias("r"), (F.col("alike") & ~F.col("some")).alias("simple")), F.col("folder").eqNullSafe(F.col("f")) & F.col("root").eqNullSafe(F.col("r")))
    rank = F.row_number().over(Window.partitionBy("folder", "name").orderBy("key"))
    ranked = marked.filter("simple").select("key", "name", rank.alias("n")).select("key", F.when(F.col("n") == 1, F.col("name")).when(F.col("n") <= MOST_SUFFIXES, F.concat("name", F.lit("-"), F.col("n").cast("string"))).alias("final"))
    rest = marked.filter("not simple").select("folder", "root", "name", "there", "key")
    kind = df.schema[order].dataType.simpleString()
    turns = rest.repartition("folder", "root").sortWithinPartitions("folder", "root", F.col("there").desc(), "key").mapInArrow(_in_turn, f"key {kind}, final string")
    given = ranked.unionByName(turns).select(F.col("key").alias("_key"), F.col("final").alias(into))
    return df.join(given, F.col(order) == F.col("_key"), "left").drop("_key")
