"""Plain-text zones and their cleanup. Native expressions, but for the reply splitter."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.rows import by_row
from postmill.options import ConvertOptions

ZONE = "struct<kind:string,content:string,confidence:double>"
FORWARD_MARK = r"(?imd)^(?:-+\s*Forwarded message\s*-+|Begin forwarded message:)\s*$"


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode counts it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _zone(kind: str, content: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), content.alias("content"), F.lit(confidence).alias("confidence"))


def _present(zones: Column) -> Column:
    return F.filter(zones, lambda z: z["content"] != "")


def forward_zones(text: Column) -> Column:
    """Zones of a forwarded message, in order; null if no line marks one."""
    parts = F.split(text, FORWARD_MARK, 2)
    marker = strip(F.regexp_extract(text, FORWARD_MARK, 0))
    zones = F.array(_zone("BODY", strip(F.get(parts, F.lit(0))), 0.8), _zone("FORWARD_HEADER", marker, 0.9), _zone("FORWARDED_BODY", strip(F.get(parts, F.lit(1))), 0.85))
    return F.when(F.regexp_like(text, F.lit(FORWARD_MARK)), _present(zones))


_REPLY = re.compile(r"^(?:On\b[^\n]*(?:\n(?!>)[^\n]+)?\bwrote:[ \t]*|-+ ?Original Message ?-+[ \t]*|From:[^\n]+\n(?:Sent|Date):[^\n]+)$", re.M)


def split_replies(text: str | None) -> list[dict]:
    """Zones of a reply: what stands first is the body, each part from a reply header or a run of quoted lines on is quoted."""
    text = (text or "").strip()
    if not text:
        return []
    heads = {m.start(): m.end() for m in _REPLY.finditer(text)}
    cuts: list[int] = []
    at, in_head_until = 0, 0
    fresh = quoted = False  # right after a header; among quoted lines
    for line in text.split("\n"):
        if at in heads:
            cuts.append(at)
            fresh, quoted, in_head_until = True, False, heads[at]
        elif at >= in_head_until and line.startswith(">"):
            if not (fresh or quoted):
                cuts.append(at)
            fresh, quoted = False, True
        elif at >= in_head_until and line.strip():
            fresh = quoted = False
        at += len(line) + 1
    edges = sorted({0, *cuts, len(text)})
    parts = [p for p in (text[a:b].strip() for a, b in zip(edges, edges[1:])) if p]
    if len(parts) == 1 and not cuts:
        return [{"kind": "BODY", "content": parts[0], "confidence": 0.7}]
    first = 0 not in cuts
    return [{"kind": "BODY" if k == 0 and first else "QUOTED", "content": p, "confidence": 0.8} for k, p in enumerate(parts)]


def reply_zones(text: Column) -> Column:
    return by_row(split_replies, f"array<{ZONE}>")(text)


def strip_signature(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\n-- ?\n.*$", "")


def strip_disclaimer(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)\n(?:confidentiality notice|disclaimer):?.*$", "")


def strip_quoted_header(c: Column) -> Column:
    """Without the first line, if that is a line of the kind `On ... wrote:`."""
    first = F.lower(F.substring_index(c, "\n", 1))
    rest = F.when(F.instr(c, "\n") > 0, F.substr(c, F.instr(c, "\n") + F.lit(1))).otherwise("")
    return F.when(first.startswith("on ") & first.endswith("wrote:"), rest).otherwise(c)


def clean_zone(kind: Column, content: Column, options: ConvertOptions) -> Column:
    """A zone's text after the chosen cleanups, stripped; steps that are off leave no trace in the plan."""
    steps: list[Callable[[Column], Column]] = []
    if options.strip_quoted_headers:
        steps.append(lambda c: F.when(kind == "QUOTED", strip_quoted_header(c)).otherwise(c))
    if options.strip_signatures:
        steps.append(strip_signature)
    if options.strip_disclaimers:
        steps.append(strip_disclaimer)
    for step in steps:
        content = step(content)
    return strip(content)


def clean_zones(zones: Column, options: ConvertOptions) -> Column:
    """All zones cleaned; those left empty go."""
    return _present(F.transform(zones, lambda z: F.struct(z["kind"].alias("kind"), clean_zone(z["kind"], z["content"], options).alias("content"), z["confidence"].alias("confidence"))))


def body_of(zones: Column) -> Column:
    """Zones that are not quoted, a blank line between; the quoted ones if there are no others."""
    text = lambda keep: F.array_join(F.transform(F.filter(zones, lambda z: keep(z["kind"]) & (strip(z["content"]) != "")), lambda z: strip(z["content"])), "\n\n")
    own = text(lambda k: k != "QUOTED")
    return strip(F.when(own != "", own).otherwise(text(lambda k: k == "QUOTED")))
