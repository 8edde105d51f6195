"""Messages to result rows: parse, filter images, segment, clean, render and diagnose."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import html as H
from postmill.functions import text as X
from postmill.functions.calendar import calendar_summaries
from postmill.functions.mime import parse_eml
from postmill.functions.names import slugify
from postmill.functions.rows import bounded_batches, by_row
from postmill.operators.diagnostics import decision, quality_state
from postmill.options import ConvertOptions

IMAGE = "struct<category:string,reason:string,reference:string>"
HTML_RESULT = f"struct<rule:string,zones:array<{X.ZONE}>,markdown:string,patterns:array<string>,raw_html:string,stripped:array<{IMAGE}>,failed:boolean,repaired:boolean,failure:string>"


def rewrite_images(markdown: str, data_uris: dict[str, str], stripped: set[str]) -> str:
    """cid references of removed images go, others become data URIs where one is known."""
    for cid in stripped:
        markdown = re.sub(r"!\[[^\]]*\]\(cid:" + re.escape(cid) + r"\)\s*", "", markdown)
    for cid, uri in data_uris.items():
        markdown = markdown.replace(f"(cid:{cid})", f"({uri})")
    return markdown


def html_stage(html: str | None, data_uris: dict[str, str], options: ConvertOptions) -> dict:
    """Everything that needs the HTML tree, in one pass over a message."""
    out: dict = {"rule": None, "zones": [], "markdown": "", "patterns": [], "raw_html": None, "stripped": [], "failed": False, "repaired": False, "failure": None}
    if not html:
        return out
    uris = data_uris if options.embed_inline_images else {}
    try:
        html, out["stripped"] = H.filter_images(html, signatures=options.strip_signature_images, pixels=options.strip_tracking_pixels)
        gone = {s["reference"][4:] for s in out["stripped"] if s["reference"].startswith("cid:")}
        clean = H.sanitize(html)
        out |= {"raw_html": clean, "patterns": H.quote_patterns(clean)}
        rule, zones = H.segment(html)
        if rule:
            texts = [(z, rewrite_images(H.markdown(z["content"]), uris, gone).strip()) for z in zones]
            out |= {"rule": rule, "zones": [{**z, "content": t} for z, t in texts if t]}
        out["markdown"] = rewrite_images(H.markdown(html), uris, gone)
    except Exception as e:  # a failed conversion is a row of the decision table
        out |= {"failed": True, "failure": str(e) or type(e).__name__}
        if options.allow_html_repair_on_panic and re.search(r"(?i)<i(\s[^>]*)?>", html):
            try:
                out |= {"markdown": H.markdown(re.sub(r"(?i)</?i(\s[^>]*)?>", "", html)), "repaired": True}
            except Exception:
                out["markdown"] = ""
    return out


def _html_udf(options: ConvertOptions):
    return by_row(lambda html, uris: html_stage(html, dict(uris or ()), options), HTML_RESULT).asNondeterministic()


def without_stripped(names: Column, removed: Column) -> Column:
    """A list of names less a list of removed ones, one for one, first ones first."""
    step = lambda state, name: F.when(
        F.array_contains(state["left"], name),
        F.struct(state["kept"].alias("kept"), F.concat(F.slice(state["left"], F.lit(1), F.array_position(state["left"], name).cast("int") - 1), F.slice(state["left"], F.array_position(state["left"], name).cast("int") + 1, F.size(state["left"]))).alias("left")),
    ).otherwise(F.struct(F.concat(state["kept"], F.array(name)).alias("kept"), state["left"].alias("left")))
    return F.aggregate(names, F.struct(F.array().cast("array<string>").alias("kept"), removed.alias("left")), step, lambda s: s["kept"])


def referenced_only(parts: Column, names: Column, reference: Column) -> tuple[Column, Column]:
    """Parts and names without the inline parts that a text does not refer to; an empty text refers to all."""
    kept = lambda p: (reference == "") | p["content_id"].isNull() | F.contains(reference, F.concat(F.lit("cid:"), p["content_id"]))
    dropped = F.transform(F.filter(parts, lambda p: ~kept(p)), lambda p: p["filename"])
    return F.filter(parts, kept), without_stripped(names, dropped)


def with_metadata(zones: Column, hint: Column | None, patterns: Column | None) -> Column:
    """Zones with a map of what is known of them: the client's hint, and on bodies the quote patterns that the message shows."""
    none = F.create_map().cast("map<string,string>")
    of_client = none if hint is None else F.when(hint.isNotNull(), F.create_map(F.lit("client_hint"), hint)).otherwise(none)
    shown = F.lit(False) if patterns is None else F.coalesce(F.size(patterns) > 0, F.lit(False))
    of_body = none if patterns is None else F.create_map(F.lit("quote_patterns"), F.array_join(F.array_sort(patterns), ","))
    meta = lambda z: F.when((z["kind"] == "BODY") & shown, F.map_concat(of_client, of_body)).otherwise(of_client)
    return F.transform(zones, lambda z: F.struct(z["kind"].alias("kind"), z["content"].alias("content"), z["confidence"].alias("confidence"), meta(z).alias("metadata")))


def convert_df(messages: DataFrame, options: ConvertOptions | None = None, *, source_col: str = "path", content_col: str = "content") -> DataFrame:
    """A result row for each row of message bytes: front-matter fields, body, zones, diagnostics, attachments and any error.

    A message that cannot be converted gives a row with success false, an empty
    subject and the sender "unknown"; it never fails the task. Null and empty
    bytes are an empty message. No shuffle; one Python pass for MIME and, if
    any text is HTML, one for the tree.
    """
    options = options or ConvertOptions()
    bounded_batches(messages.sparkSession)
    parsed = messages.select(F.col(source_col).alias("source"), parse_eml(F.col(content_col)).alias("p")).select("source", "p.*")
    staged = parsed.withColumn("h", _html_udf(options)(F.col("html_body"), F.col("inline_cid_to_data_uri")))
    rule_zones = X.clean_zones(F.col("h.zones"), options)
    rule = F.when(F.size(rule_zones) > 0, F.col("h.rule"))
    kind, markdown_blank = F.col("selected_body_kind"), X.strip(F.col("h.markdown")) == ""
    failed, repaired = F.coalesce(F.col("h.failed"), F.lit(False)), F.coalesce(F.col("h.repaired"), F.lit(False))
    verdict = decision(kind, rule, failed, repaired, markdown_blank, F.col("h.patterns"), X.strip(F.col("text_body")) == "", options.allow_fallback_on_html_error)
    staged = staged.withColumns({"_rule": rule, "_rule_zones": rule_zones, "d": verdict})
    use_markdown = kind.eqNullSafe("html") & ~markdown_blank & (~failed | repaired)
    staged = staged.withColumn("_text", F.when(use_markdown, F.col("h.markdown")).otherwise(F.col("text_body")))
    text_zones = X.clean_zones(F.coalesce(X.forward_zones(X.strip(F.col("_text"))), X.reply_zones(F.col("_text"))), options)
    staged = staged.withColumn("zones", F.when(F.col("_rule").isNotNull(), with_metadata(F.col("_rule_zones"), F.col("d.hint"), None)).otherwise(with_metadata(text_zones, None, F.col("h.patterns"))))
    calendar = F.array().cast("array<string>") if options.no_calendar_summary else calendar_summaries(F.col("calendar_parts"))
    of_conversion = F.when(F.col("d.warning").isNotNull(), F.struct(F.col("d.warning").alias("code"), F.coalesce(F.col("h.failure"), F.lit("")).alias("message"), F.lit("warning").alias("severity")))
    warnings = F.concat(F.array_compact(F.array(of_conversion)), F.transform("defects", lambda x: F.struct(x["code"].alias("code"), x["message"].alias("message"), x["severity"].alias("severity"))))
    error = F.coalesce(F.col("error"), F.col("d.error"))
    ok = error.isNull()
    parts = F.col("attachment_parts")
    names = F.col("attachments")
    body = X.body_of(F.col("zones"))
    if options.strips_images:
        gone = F.transform(F.filter(F.col("h.stripped"), lambda s: s["reference"].startswith("cid:")), lambda s: F.substr(s["reference"], F.lit(5)))
        removed_names = F.array_compact(F.transform(gone, lambda c: F.element_at("inline_cid_to_filename", c)))
        reference = F.concat(body, F.coalesce(F.col("h.raw_html"), F.lit(""))) if options.include_raw_html else body
        parts = F.filter(parts, lambda p: p["content_id"].isNull() | ~F.array_contains(gone, p["content_id"]))
        parts, names = referenced_only(parts, without_stripped(names, removed_names), reference)
    none = F.lit(None).cast("string")
    return staged.select(
        "source",
        F.when(ok, F.col("subject")).otherwise("").alias("subject"),
        F.when(ok, F.col("sender")).otherwise("unknown").alias("sender"),
        F.when(ok, F.col("date")).alias("date"),
        F.when(ok, names).otherwise(F.array().cast("array<string>")).alias("attachments"),
        F.when(ok, calendar).alias("calendar"),
        (F.when(ok, F.col("headers")) if options.include_all_headers else F.lit(None).cast("map<string,string>")).alias("headers"),
        (F.when(ok, F.col("h.raw_html")) if options.include_raw_html else none).alias("raw_html"),
        F.when(ok, F.col("zones")).alias("zones"),
        F.when(ok, body).alias("body"),
        F.when(ok, slugify(F.when(X.strip(F.col("subject")) != "", F.col("subject")).otherwise(F.regexp_replace(F.regexp_extract("source", r"([^/]*)$", 1), r"\.[^.]*$", "")))).alias("slug"),
        F.when(
            ok,
            F.struct(
                quality_state(F.col("d.confidence"), F.size(warnings)).alias("state"), F.coalesce(kind, F.lit("plain")).alias("selected_body"), F.col("d.path").alias("segmentation_path"), F.col("d.hint").alias("client_hint"),
                F.col("d.confidence").alias("confidence"), F.col("d.fallback").alias("fallback_used"), warnings.alias("warnings"), F.when(F.size("h.stripped") > 0, F.col("h.stripped")).alias("stripped_images"),
            ),
        ).alias("diagnostics"),
        parts.alias("attachment_parts"),
        ok.alias("success"),
        error.alias("error"),
        F.when(error == "html_markdown_failed", error).alias("error_code"),
        F.when(error == "html_markdown_failed", X.strip(F.col("text_body")) != "").alias("plain_text_fallback_available"),
        F.when(error == "html_markdown_failed", F.regexp_like("html_body", F.lit(r"(?i)<i(\s[^>]*)?>"))).alias("html_repair_available"),
    )


def front_matter(row: dict) -> dict:
    """The front matter of a result row, keys in their fixed order, optional ones only where there is something."""
    found = {k: row[k] for k in ("source", "subject", "sender", "date")} | {"attachments": list(row["attachments"] or [])}
    for k in ("attachment_files", "calendar"):
        if row.get(k):
            found[k] = list(row[k])
    if row.get("headers") is not None:
        found["headers"] = dict(row["headers"])
    if row.get("raw_html") is not None:
        found["raw_html"] = row["raw_html"]
    return found


def document(row: dict) -> str:
    """The final text of a result row: YAML front matter and the body."""
    import yaml

    head = yaml.safe_dump(front_matter(row), sort_keys=False, allow_unicode=True).strip()
    body = (row["body"] or "").strip()
    return f"---\n{head}\n---\n\n{body}\n" if body else f"---\n{head}\n---\n"


def zones_of(results: DataFrame) -> DataFrame:
    """(source, ord, kind, content, confidence, metadata), a row for each zone."""
    return results.select("source", F.posexplode("zones").alias("ord", "z")).select("source", "ord", "z.*")


def attachments_of(results: DataFrame) -> DataFrame:
    """(source, ord, filename, content_type, payload, content_id, disposition), a row for each attachment with content."""
    return results.select("source", F.posexplode("attachment_parts").alias("ord", "a")).select("source", "ord", "a.*")
