"""Summaries of calendar parts."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column

from postmill.functions.rows import by_row


def _moment(params: str, value: str) -> str | None:
    try:
        if re.fullmatch(r"\d{8}", value):
            return datetime.strptime(value, "%Y%m%d").date().isoformat()
        when = datetime.strptime(value.removesuffix("Z"), "%Y%m%dT%H%M%S")
        if value.endswith("Z"):
            return when.isoformat() + "+00:00"
        if zone := re.search(r"TZID=\"?([^;:\"]+)", params):
            return when.replace(tzinfo=ZoneInfo(zone[1])).isoformat()
        return when.isoformat()
    except (ValueError, KeyError, OSError):
        return None


def summaries(parts: list[str] | None) -> list[str]:
    """A line for every event of every readable part: `SUMMARY (start -> end)`, with what is known of the times."""
    out = []
    for part in parts if parts is not None else []:
        if "BEGIN:VCALENDAR" not in (part or ""):
            continue
        unfolded = re.sub(r"\r?\n[ \t]", "", part)
        for event in re.findall(r"BEGIN:VEVENT\r?\n(.*?)END:VEVENT", unfolded, re.S):
            field = {m[1].upper(): (m[2] or "", m[3].strip()) for m in re.finditer(r"^([A-Za-z-]+)((?:;[^:\n]*)?):(.*)$", event, re.M)}
            text = re.sub(r"\\([\;,nN])", lambda m: "\n" if m[1] in "nN" else m[1], field.get("SUMMARY", ("", ""))[1]) or "(no summary)"
            start, end = (_moment(*field[k]) if k in field else None for k in ("DTSTART", "DTEND"))
            out.append(f"{text} ({start} -> {end})" if start and end else f"{text} ({start})" if start else text)
    return out


def calendar_summaries(parts: Column) -> Column:
    return by_row(summaries, "array<string>")(parts)
