"""License scans: normalised text compared to licence templates by the Dice coefficient of word bigrams.

Every line of a text and the whole text are compared. With b bigrams in the
template and a coefficient of at least t, a text must have between
b * t / (2 - t) and b * (2 - t) / t bigrams; templates outside these bounds are
never compared, and most lines fall outside the bounds of all. DataFrame
operations only; nothing is shuffled. Passages that are neither a line nor a
whole text, and the texts of licences, are for license_passages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8
#: Short notices by which texts name their licence, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """The distinct word bigrams of each template, normalised as texts are."""
    found = {}
    for name, text in sorted(templates.items()):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        found[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bigrams(text: Column) -> Column:
    def pairs(words: Column) -> Column:
        return F.transform(words, lambda w, i: F.when(i > 0, F.concat_ws(" ", F.get(words, i - 1), w)))

    return F.array_distinct(F.array_compact(_let(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), pairs)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_DICE) -> DataFrame:
    """(id, unit, license, dice): for each line (unit 1, 2, ...) or whole text of several lines (unit 0) its best template, if it reaches `least`.

    Ties go to the name that is first in order. A null or empty text matches
    nothing; templates of fewer than two words neither. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty
    one.
    """
    known = {k: v for k, v in template_bigrams(templates).items() if v}
    sizes = [len(v) for v in known.values()] or [0]
    low, high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.array_join(lines, "\n")), lines)).otherwise(lines)
    first = F.when(F.size(lines) > 1, 0).otherwise(1)
    rows = docs.select(F.col(id_col), first.alias("_first"), F.posexplode(units).alias("_at", "_unit"))
    # A text of n characters has at least n / 2 words or longer ones; only its bigrams tell, so this first bound is of words.
    words = F.regexp_count("_unit", F.lit(r"[\p{L}\p{N}]+"))
    near = rows.filter(words > low).select(id_col, (F.col("_first") + F.col("_at")).alias("unit"), "_unit")
    choices = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known.items()] or [F.struct(F.lit("").alias("license"), F.array(F.lit("")).alias("grams"))])

    def best(own: Column) -> Column:
        a = F.size(own)
        bounded = F.filter(choices, lambda t: a.between(F.size(t["grams"]) * least / (2 - least), F.size(t["grams"]) * (2 - least) / least))
        dice = lambda t: F.struct((-2 * F.size(F.array_intersect(own, t["grams"])) / (a + F.size(t["grams"]))).alias("minus"), t["license"].alias("license"))
        return F.when(a.between(low, high), F.array_min(F.transform(bounded, dice)))

    sized = near.select(id_col, "unit", _let(_bigrams(F.col("_unit")), best).alias("_best"))
    return sized.select(id_col, F.col("unit").cast("int").alias("unit"), F.col("_best.license").alias("license"), F.round(-F.col("_best.minus"), 6).alias("dice")).filter(F.col("dice") >= least)
