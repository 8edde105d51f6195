"""Quality diagnostics: the decision table, states, hints and grades, as case expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECISION = ("path", "hint", "confidence", "fallback")


def client_hint(patterns: Column) -> Column:
    return F.when(F.array_contains(patterns, "gmail"), "gmail").when(F.array_contains(patterns, "outlook"), "outlook").otherwise("generic")


def decision(kind: Column, rule: Column, failed: Column, repaired: Column, blank: Column, patterns: Column, text_blank: Column, may_fall_back: bool) -> Column:
    """(path, hint, confidence, fallback, warning, error) of a message.

    `rule` is the HTML quoting rule whose zones survive, or null; `blank` tells
    whether the Markdown in use is blank; `patterns` are the quote patterns.
    """

    def row(path: str | None, hint: Column | str | None, sure: str | None, fallback: str | None, warning: str | None = None, error: str | None = None) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(*(as_col(v).alias(n) for v, n in ((path, "path"), (hint, "hint"), (sure, "confidence"), (fallback, "fallback"), (warning, "warning"), (error, "error"))))

    html, quoted = kind.eqNullSafe("html"), F.size(patterns) > 0
    return (
        F.when(html & rule.isNotNull(), row("html", F.when(rule == "gmail_quote", "gmail").otherwise("outlook"), "high", None))
        .when(~html, row("plain_fallback", "generic", "medium", "plain_text_reply_parser"))
        .when(~failed & blank, row("plain_fallback", "generic", "medium", None))
        .when(~failed & quoted, row("plain_fallback", client_hint(patterns), "low", "plain_text_reply_parser"))
        .when(~failed, row("html", "generic", "medium", None))
        .when(repaired & blank, row("plain_fallback", "generic", "medium", None, "html_markdown_repaired"))
        .when(repaired & quoted, row("plain_fallback", client_hint(patterns), "medium", "html_markdown_panic_repaired", "html_markdown_repaired"))
        .when(repaired, row("html", "generic", "medium", "html_markdown_panic_repaired", "html_markdown_repaired"))
        .when(F.lit(may_fall_back) & ~text_blank, row("plain_fallback", "generic", "low", "html_failure_plain_text_fallback", "html_markdown_failed"))
        .otherwise(row(None, None, None, None, None, "html_markdown_failed"))
    )


def quality_state(confidence: Column, n_warnings: Column) -> Column:
    return F.when(confidence == "low", "review_recommended").when(n_warnings > 0, "degraded").otherwise("normal")


def grade(status: Column, state: Column) -> Column:
    return F.when(status == "failed", "fail").when(state == "normal", "pass").when(state.isin("degraded", "review_recommended"), "review")
