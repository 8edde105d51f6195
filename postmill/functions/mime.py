"""MIME decoding: message bytes to one struct, in a vectorised UDF over the standard library's parser."""

from __future__ import annotations

import email
import email.policy
from datetime import UTC
from email.header import decode_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

from pyspark.sql import Column

from postmill.functions.rows import by_row

PART = "struct<filename:string,content_type:string,payload:binary,content_id:string,disposition:string>"
PARSED = (
    "struct<subject:string,sender:string,date:string,text_body:string,html_body:string,headers:map<string,string>,attachments:array<string>,"
    f"attachment_parts:array<{PART}>,inline_cid_to_filename:map<string,string>,inline_cid_to_data_uri:map<string,string>,calendar_parts:array<string>,"
    "body_candidates:array<struct<kind:string,content:string,source_part_id:string>>,selected_body_kind:string,"
    "defects:array<struct<part_id:string,code:string,message:string,severity:string>>,error:string>"
)


def decoded(raw: str | None) -> str:
    """A header with RFC 2047 words decoded, fragments joined as they stand, stripped."""
    if not raw:
        return ""
    pieces = []
    for value, charset in decode_header(str(raw)):
        if isinstance(value, bytes):
            try:
                value = value.decode(charset or "utf-8", "replace")
            except LookupError:
                value = value.decode("utf-8", "replace")
        pieces.append(value)
    return "".join(pieces).strip()


def iso_date(raw: str | None) -> str | None:
    """An RFC 2822 date in ISO 8601 with its offset (UTC if it has none); None if it cannot be read."""
    if not raw:
        return None
    try:
        when = parsedate_to_datetime(str(raw))
    except (TypeError, ValueError, IndexError):
        return None
    return (when if when.tzinfo else when.replace(tzinfo=UTC)).isoformat()


def clean_filename(raw: str | None) -> str:
    """The last usable part of a path-like name: "" for nothing, "attachment" if every part is unusable."""
    name = (raw or "").strip().replace("\0", "")
    if not name:
        return ""
    usable = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return usable[-1] if usable else "attachment"


def sender_of(message: Message) -> str:
    """Address, else name, of the first sender. Encoded words are decoded after the list is split: they may hold commas."""
    for name, address in getaddresses([str(v) for v in message.get_all("From", [])])[:1]:
        return address or decoded(name) or "unknown"
    return "unknown"


def defects_of(part: Message) -> list[dict]:
    """What the parser found wrong with a part."""
    found = ((type(d).__name__, str(d).strip()) for d in part.defects)
    return [{"part_id": "root", "code": "mime_defect", "message": f"{name}: {line}" if line else name, "severity": "warning"} for name, line in found]


def is_calendar(part: Message) -> bool:
    return "text/calendar" in str(part.get("Content-Type") or "").partition(";")[0].lower()


def _calendar_text(part: Message) -> str:
    """Base64 is UTF-8; anything else is as its charset says."""
    if str(part.get("Content-Transfer-Encoding") or "").strip().lower() == "base64":
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    return _text(part)


def _text(part: Message) -> str:
    raw = part.get_payload(decode=True)
    if raw is None:
        return ""
    try:
        text = raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def body_candidates(plain: str, html: list[str]) -> list[dict]:
    """Non-blank HTML bodies in order, then the plain one."""
    found = [{"kind": "html", "content": h, "source_part_id": f"html-{k}"} for k, h in enumerate(html, 1) if h.strip()]
    return found + ([{"kind": "plain", "content": plain, "source_part_id": "plain-1"}] if plain.strip() else [])


def selected(candidates: list[dict]) -> dict | None:
    """The last HTML candidate, else the last plain one."""
    for kind in ("html", "plain"):
        if of_kind := [c for c in candidates if c["kind"] == kind]:
            return of_kind[-1]
    return None


def parse(content: bytes | None) -> dict:
    """All fields of PARSED for one message; what cannot be parsed gives a row with `error`."""
    out: dict = {"subject": "", "sender": "unknown", "date": None, "text_body": "", "html_body": None, "headers": {}, "attachments": [], "attachment_parts": [], "inline_cid_to_filename": {}, "inline_cid_to_data_uri": {}, "calendar_parts": [], "body_candidates": [], "selected_body_kind": None, "defects": [], "error": None}
    try:
        message = email.message_from_bytes(content or b"", policy=email.policy.compat32)
        out |= {"subject": decoded(message["Subject"]), "sender": sender_of(message), "date": iso_date(message["Date"])}
        for key, value in message.items():
            value = decoded(value)
            out["headers"][key] = f"{out['headers'][key]}, {value}" if key in out["headers"] else value
        plain, html = [], []
        for part in message.walk():
            out["defects"] += defects_of(part)
            if part.is_multipart():
                continue
            kind, disposition, name = part.get_content_type(), (part.get_content_disposition() or ""), decoded(part.get_filename())
            cid = str(part["Content-ID"] or "").strip().strip("<>")
            if is_calendar(part) and (text := _calendar_text(part)):
                out["calendar_parts"].append(text)
            if kind in ("text/plain", "text/html") and disposition != "attachment" and not name:
                (plain if kind == "text/plain" else html).append(_text(part))
                continue
            name = clean_filename(name)
            payload = part.get_payload(decode=True)
            if name:
                out["attachments"].append(name)
                if payload:
                    out["attachment_parts"].append({"filename": name, "content_type": kind, "payload": payload, "content_id": cid or None, "disposition": disposition or "attachment"})
                if cid:
                    out["inline_cid_to_filename"][cid] = name
            if cid and str(part["Content-Transfer-Encoding"] or "").strip().lower() == "base64":
                out["inline_cid_to_data_uri"][cid] = f"data:{kind};base64,{''.join(part.get_payload().split())}"
        candidates = body_candidates("\n".join(plain), html)
        chosen = selected(candidates)
        out |= {"text_body": "\n".join(plain), "body_candidates": candidates, "selected_body_kind": chosen and chosen["kind"], "html_body": chosen["content"] if chosen and chosen["kind"] == "html" else None}
    except Exception as e:  # one bad message is one failure row
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _row(content: bytes | None) -> dict:
    """`parse`, maps as Arrow takes them."""
    return {k: list(v.items()) if isinstance(v, dict) else v for k, v in parse(content).items()}


def parse_eml(content: Column) -> Column:
    """The PARSED struct of message bytes; evaluated once a row, also under filters on its fields."""
    return by_row(_row, PARSED).asNondeterministic()(content)
