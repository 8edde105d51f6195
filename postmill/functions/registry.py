"""Functions for SQL users: call :func:`register` once for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from postmill.functions import html, mime, names, text
from postmill.functions.rows import bounded_batches, by_row


def register(spark: SparkSession) -> list[str]:
    """Register slugify, sanitize_html, html_to_markdown, quote_patterns, reply_zones and parse_eml; the names."""
    bounded_batches(spark)
    functions = {
        "slugify": by_row(names.slug, "string"),
        "sanitize_html": by_row(html.sanitize, "string"),
        "html_to_markdown": by_row(html.markdown, "string"),
        "quote_patterns": by_row(lambda h: html.quote_patterns(html.sanitize(h)), "array<string>"),
        "reply_zones": by_row(text.split_replies, f"array<{text.ZONE}>"),
        "parse_eml": by_row(mime._row, mime.PARSED),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    return sorted(functions)
