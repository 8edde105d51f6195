"""The registered queries of the library's operators and their SQL.

The driver's tables hold no mail, so messages, addresses and paths are made in
each query from table columns, and the SQL makes the same ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.functions import html as H
from postmill.functions import mime, names, text
from postmill.functions.calendar import calendar_summaries
from postmill.functions.mime import parse_eml
from postmill.functions.rows import bounded_batches, by_row
from postmill.operators import convert, diagnostics, reports, ui
from postmill.options import ConvertOptions
from postmill.sources.eml import is_message
from postmill.sources.listing import drop_split, placed
from postmill.streaming.watch import dedupe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ALL = ConvertOptions(strip_signatures=True, strip_disclaimers=True, strip_quoted_headers=True)


def query(table: str, sql: str):
    """Register a function of one table under its own name, with its SQL."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return f(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[f.__name__] = run
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


C = F.col


def _s(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


# --- MIME -------------------------------------------------------------------

_DATE_SQL = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 61), '%Y-%m-%dT%H:%M:%S') || '+02:00'"


def _message(subject: Column, sender: Column, date: Column, body: Column) -> Column:
    return _s("From: ", sender, "\r\nSubject: ", subject, "\r\nDate: ", date, "\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n", body).cast("binary")


@query("documents", f"SELECT doc_id, 'note ' || doc_id AS subject, source || '@example.org' AS sender, {_DATE_SQL} AS date, length(text) AS body_chars, md5(text) AS body_md5 FROM documents")
def mail_roundtrip(t: DataFrame) -> DataFrame:
    at = F.timestamp_add("SECOND", C("doc_id") * 61, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    mail = _message(_s("note ", C("doc_id")), _s("Some One <", C("source"), "@example.org>"), _s(F.date_format(at, "d MMM yyyy HH:mm:ss"), " +0200"), C("text"))
    p = t.select("doc_id", parse_eml(mail).alias("p")).select("doc_id", "p.subject", "p.sender", "p.date", "p.text_body")
    return p.select("doc_id", "subject", "sender", "date", F.length("text_body").cast("long").alias("body_chars"), F.md5(C("text_body").cast("binary")).alias("body_md5"))


@query("documents", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'u' || doc_id || '@x.org' WHEN 1 THEN 'v' || doc_id || '@x.org' WHEN 2 THEN 'Name' || doc_id WHEN 3 THEN 'unknown' WHEN 4 THEN 'w' || doc_id || '@x.org' ELSE 'Doe, J' || doc_id END AS sender FROM documents")
def mail_sender_resolve(t: DataFrame) -> DataFrame:
    k = C("doc_id") % 6
    raw = F.when(k == 0, _s("A B <u", C("doc_id"), "@x.org>, C <c@x.org>")).when(k == 1, _s("v", C("doc_id"), "@x.org")).when(k == 2, _s("Name", C("doc_id"), " <>")).when(k == 4, _s("=?utf-8?q?Doe=2C_J?= <w", C("doc_id"), "@x.org>")).when(k == 5, _s("=?utf-8?q?Doe=2C_J", C("doc_id"), "?= <>")).otherwise("")
    return t.select("doc_id", parse_eml(_message(F.lit("s"), raw, F.lit(""), F.lit("b")))["sender"].alias("sender"))


# The whole text, a line a word of its own: lines of encoded words are joined as they stand.
@query("documents", r"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '^[ \t\r\f\x0b\n]+|[ \t\r\f\x0b\n]+$', '', 'g'), '\s+', ' ', 'g')) AS subject_md5 FROM documents")
def mail_subject_rfc2047(t: DataFrame) -> DataFrame:
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\f\x0b\n]+", " ")
    pieces = F.regexp_extract_all(flat, F.lit("(?s).{1,30}"), F.lit(0))
    words = F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("=?utf-8?b?"), F.base64(p.cast("binary")), F.lit("?="))), "\r\n ")
    return t.select("doc_id", F.md5(parse_eml(_message(words, F.lit("a@b.c"), F.lit(""), F.lit("b")))["subject"].cast("binary")).alias("subject_md5"))


@query("documents", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_DATE_SQL} WHEN 1 THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 61), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS date FROM documents")
def mail_date_iso(t: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_add("SECOND", C("doc_id") * 61, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "d MMM yyyy HH:mm:ss")
    raw = F.when(C("doc_id") % 3 == 0, _s(at, " +0200")).when(C("doc_id") % 3 == 1, _s(at, " -0000")).otherwise("no date")
    return t.select("doc_id", parse_eml(_message(F.lit("s"), F.lit("a@b.c"), raw, F.lit("b")))["date"].alias("date"))


@query("conversations", "SELECT conv_id, turn, text AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn DESC) AS rn FROM conversations WHERE trim(text) <> '') WHERE rn = 1")
def body_select_last_html(t: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.when(C("role") == "assistant", "html").otherwise("plain").alias("kind"), C("text").alias("content"))))

    def chosen(candidates: list[dict]) -> dict:
        found = mime.selected(sorted(candidates, key=lambda x: x["turn"])) or {"turn": None, "content": None}
        return {"turn": found["turn"], "body": found["content"]}

    picked = by_row(chosen, "struct<turn:long,body:string>").asNondeterministic()
    return t.filter(F.trim("text") != "").groupBy("conv_id").agg(turns.alias("c")).select("conv_id", picked("c").alias("b")).select("conv_id", "b.*")


@query("pages", r"SELECT page_id, coalesce(list_filter(regexp_split_to_array(raw, '[\\/]+'), lambda p: p NOT IN ('', '.', '..'))[-1], 'attachment') AS name FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'c:\dir\' || page_id || '.txt' WHEN 2 THEN '../..' ELSE '  ' || page_id || '.pdf ' END AS r, trim(r) AS raw FROM pages)")
def attachment_name_clean(t: DataFrame) -> DataFrame:
    k = C("page_id") % 4
    raw = F.when(k == 0, C("url")).when(k == 1, _s("c:\\dir\\", C("page_id"), ".txt")).when(k == 2, "../..").otherwise(_s("  ", C("page_id"), ".pdf "))
    return t.select("page_id", names.clean_filename(raw).alias("name"))


def _mixed(doc_id: Column, body: Column) -> Column:
    part = lambda name, cid, data: _s("--b\r\nContent-Type: image/png; name=\"", name, "\"\r\nContent-Transfer-Encoding: base64\r\nContent-ID: <", cid, ">\r\nContent-Disposition: inline; filename=\"", name, "\"\r\n\r\n", F.base64(data.cast("binary")), "\r\n")
    return _s("From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n", body, "\r\n", part(_s("a", doc_id, ".png"), _s("c", doc_id), _s("data", doc_id)), part(_s("dir/b.png"), _s("d", doc_id), _s("more", doc_id)), "--b--\r\n").cast("binary")


@query("documents", "SELECT doc_id, ord, CASE ord WHEN 0 THEN 'a' || doc_id || '.png' ELSE 'b.png' END AS filename, 'image/png' AS content_type, md5(CASE ord WHEN 0 THEN 'data' ELSE 'more' END || doc_id) AS payload_md5, CASE ord WHEN 0 THEN 'c' ELSE 'd' END || doc_id AS content_id FROM documents, (VALUES (0), (1)) o(ord)")
def attachment_explode(t: DataFrame) -> DataFrame:
    p = t.select("doc_id", parse_eml(_mixed(C("doc_id"), F.lit("b")))["attachment_parts"].alias("a"))
    return p.select("doc_id", F.posexplode("a").alias("ord", "x")).select("doc_id", "ord", "x.filename", "x.content_type", F.md5("x.payload").alias("payload_md5"), "x.content_id")


@query("documents", "SELECT doc_id, 'a' || doc_id || '.png' AS filename, 'see ![](data:image/png;base64,' || to_base64(encode('data' || doc_id)) || ')' AS body FROM documents")
def cid_map_lookup(t: DataFrame) -> DataFrame:
    p = t.select("doc_id", parse_eml(_mixed(C("doc_id"), F.lit("b"))).alias("p")).select("doc_id", "p.inline_cid_to_filename", C("p.inline_cid_to_data_uri").alias("u"))
    cid = _s("c", C("doc_id"))
    body = by_row(lambda x, uris: convert.rewrite_images(x, dict(uris), {"gone"}), "string")(_s("see ![a](cid:gone) ![](cid:", cid, ")"), C("u"))
    return p.select("doc_id", F.element_at("inline_cid_to_filename", cid).alias("filename"), body.alias("body"))


# --- images -----------------------------------------------------------------

_SRC_SQL = "CASE doc_id % 5 WHEN 0 THEN 'https://lh3.googleusercontent.com/mail-sig/' || doc_id WHEN 1 THEN 'https://x.org/Logo.png' WHEN 2 THEN 'cid:photo' || doc_id WHEN 3 THEN 'https://x.org/' || source || '/badge.gif' ELSE 'https://x.org/photo.jpg' END"


def _src() -> Column:
    k, i = C("doc_id") % 5, C("doc_id")
    return F.when(k == 0, _s("https://lh3.googleusercontent.com/mail-sig/", i)).when(k == 1, "https://x.org/Logo.png").when(k == 2, _s("cid:photo", i)).when(k == 3, _s("https://x.org/", C("source"), "/badge.gif")).otherwise("https://x.org/photo.jpg")


@query("documents", f"SELECT doc_id, CASE WHEN contains({_SRC_SQL}, 'googleusercontent.com/mail-sig/') THEN 'gmail_mail_sig_url' WHEN contains(lower({_SRC_SQL}), 'logo') THEN 'filename_pattern:logo' WHEN contains({_SRC_SQL}, 'badge') THEN 'filename_pattern:badge' END AS reason FROM documents")
def img_signature_reason(t: DataFrame) -> DataFrame:
    reason = lambda x: next((s["reason"] for s in H.filter_images(x, signatures=True, pixels=False)[1]), None)
    return t.select("doc_id", by_row(reason, "string")(_s('<p>x<img src="', _src(), '"></p>')).alias("reason"))


@query(
    "documents",
    """SELECT doc_id, CASE WHEN (w IN ('0', '1') AND h IN ('0', '1')) OR (w IN ('0', '1') AND h = '') OR (h IN ('0', '1') AND w = '') THEN 'dimension_heuristic'
    WHEN st LIKE '%width:1px;height%' OR (st = 'height:1px' AND (w IN ('0', '1') OR (w = '' AND h IN ('0', '1')))) THEN 'dimension_heuristic' WHEN st LIKE '%display: none%' THEN 'hidden_image' END AS reason
    FROM (SELECT doc_id, ['0', '1px', '20', '', '1', ' 1'][1 + doc_id % 6] AS w, ['1', '', '30', '1px'][1 + (doc_id // 6) % 4] AS h, ['', 'width:1px;height:1px;', 'display: none', 'max-width:1px;', 'height:1px'][1 + (doc_id // 24) % 5] AS st FROM documents)""",
)
def img_tracking_reason(t: DataFrame) -> DataFrame:
    pick = lambda k, *v: F.get(F.array(*map(F.lit, v)), k.cast("int"))
    i = C("doc_id")
    w, h = pick(i % 6, "0", "1px", "20", "", "1", " 1"), pick(F.floor(i / 6) % 4, "1", "", "30", "1px")
    style = pick(F.floor(i / 24) % 5, "", "width:1px;height:1px;", "display: none", "max-width:1px;", "height:1px")
    page = _s('<p><img src="https://x.org/p.jpg" width="', w, '" height="', h, '" style="', style, '"></p>')
    reason = lambda x: next((s["reason"] for s in H.filter_images(x, signatures=False, pixels=True)[1]), None)
    return t.select("doc_id", by_row(reason, "string")(page).alias("reason"))


@query(
    "lineitem",
    "WITH n AS (SELECT l_orderkey, l_shipmode_ AS name, l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey, l_shipmode_ ORDER BY l_linenumber) AS rn FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)), r AS (SELECT l_orderkey, l_returnflag AS name, count(*) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) SELECT n.l_orderkey, count(*) AS kept, string_agg(n.name, ',' ORDER BY n.ord, n.name) AS names FROM n LEFT JOIN r ON n.l_orderkey = r.l_orderkey AND n.name = r.name WHERE r.m IS NULL OR n.rn > r.m GROUP BY n.l_orderkey",
)
def img_strip_multiset(t: DataFrame) -> DataFrame:
    lists = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    left = convert.without_stripped(C("x.l_returnflag"), F.transform(F.filter("x", lambda e: e["l_linenumber"] == 1), lambda e: e["l_returnflag"]))
    kept = lists.select("l_orderkey", left.alias("n")).filter(F.size("n") > 0)
    return kept.select("l_orderkey", F.size("n").cast("long").alias("kept"), F.array_join("n", ",").alias("names"))


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 4 ELSE 2 END AS kept, CASE doc_id % 3 WHEN 0 THEN 'a,c' WHEN 1 THEN 'b,c' ELSE 'a,b,a,c' END AS names FROM documents")
def img_retain_referenced(t: DataFrame) -> DataFrame:
    part = lambda name, cid: F.struct(F.lit(name).alias("filename"), F.lit(cid).cast("string").alias("content_id"))
    body = F.when(C("doc_id") % 3 == 2, "").otherwise(_s("see cid:i", C("doc_id") % 3))
    parts, kept = convert.referenced_only(F.array(part("a", "i0"), part("b", "i1"), part("a", "i2"), part("c", None)), F.array(*map(F.lit, "abac")), body)
    return t.select("doc_id", F.size(parts).alias("kept"), F.array_join(kept, ",").alias("names"))


# --- HTML -------------------------------------------------------------------


@query("pages", "SELECT page_id, false AS active, (html LIKE '%<h1>%') AS has_h1 FROM pages")
def html_no_active_content(t: DataFrame) -> DataFrame:
    clean = t.select("page_id", by_row(H.sanitize, "string")(C("html")).alias("h"))
    return clean.select("page_id", F.regexp_like("h", F.lit(r"(?i)<(script|style|nav|footer)\b|<!--")).alias("active"), F.contains("h", F.lit("<h1>")).alias("has_h1"))


@query("pages", "SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) WHERE lower(tag) IN ('a', 'b', 'blockquote', 'br', 'code', 'div', 'em', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'hr', 'i', 'img', 'li', 'ol', 'p', 'pre', 'span', 'strong', 'sub', 'sup', 'table', 'tbody', 'td', 'th', 'thead', 'tr', 'ul') GROUP BY ALL")
def html_tag_inventory(t: DataFrame) -> DataFrame:
    tags = F.regexp_extract_all(by_row(H.sanitize, "string")(C("html")), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return t.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("pages", """SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(t: DataFrame) -> DataFrame:
    return t.select("page_id", F.explode(F.regexp_extract_all(by_row(H.sanitize, "string")(C("html")), F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query("pages", """SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def html_markdown_links(t: DataFrame) -> DataFrame:
    links = F.regexp_count(by_row(H.markdown, "string")(C("html")), F.lit(r"\]\([^)]+\)"))
    return t.select("page_id", links.cast("long").alias("n")).filter("n > 0")


@query("documents", "SELECT doc_id, doc_id % 2 = 0 AS italic, '<p>x' || doc_id || ' y</p>' AS unwrapped FROM documents")
def html_italic_repair(t: DataFrame) -> DataFrame:
    page = F.when(C("doc_id") % 2 == 0, _s("<p>x<i>", C("doc_id"), "</i> y</p>")).otherwise(_s("<p>x", C("doc_id"), " y</p>"))
    return t.select("doc_id", by_row(H.has_italic, "boolean")(page).alias("italic"), by_row(H.unwrap_italic, "string")(page).alias("unwrapped"))


@query("documents", "SELECT doc_id, ['gmail', 'outlook', 'yahoo', 'apple_mail,generic,thunderbird', 'generic', ''][1 + doc_id % 6] AS patterns, ['gmail', 'outlook', 'generic', 'generic', 'generic', 'generic'][1 + doc_id % 6] AS hint FROM documents")
def html_quote_patterns(t: DataFrame) -> DataFrame:
    pages = ['<div class="x gmail_quote">q</div>', '<div id="divRplyFwdMsg">q</div>', '<div class="yahoo_quoted">q</div>', '<blockquote type="cite">q</blockquote>', "<p>On Monday someone wrote: </p>", '<span class="gmail_quote">q</span>']
    found = by_row(lambda h: H.quote_patterns(H.sanitize(h)), "array<string>")(F.get(F.array(*map(F.lit, pages)), (C("doc_id") % 6).cast("int")))
    p = t.select("doc_id", found.alias("p"))
    return p.select("doc_id", F.array_join("p", ",").alias("patterns"), diagnostics.client_hint(C("p")).alias("hint"))


def _zones(page: Column) -> Column:
    def split(h: str) -> list[str]:
        rule, zones = H.segment(h)
        return [rule or "", *(H.markdown(z["content"]) for z in zones)]

    return by_row(split, "array<string>")(page)


@query("documents", "SELECT doc_id, 'gmail_quote' AS rule, 'reply ' || doc_id || chr(10) || chr(10) || 'after' AS body, 'old ' || source AS quoted FROM documents")
def html_segment_gmail(t: DataFrame) -> DataFrame:
    z = t.select("doc_id", _zones(_s("<p>reply ", C("doc_id"), '</p><div class="gmail_quote">old ', C("source"), "</div><p>after</p>")).alias("z"))
    return z.select("doc_id", F.get("z", F.lit(0)).alias("rule"), F.get("z", F.lit(1)).alias("body"), F.get("z", F.lit(2)).alias("quoted"))


@query("documents", "SELECT doc_id, 'outlook_divRplyFwdMsg' AS rule, 'reply ' || doc_id AS body, 'From: ' || source || chr(10) || chr(10) || 'after' AS quoted FROM documents")
def html_segment_outlook(t: DataFrame) -> DataFrame:
    z = t.select("doc_id", _zones(_s("<div><p>reply ", C("doc_id"), '</p><div id="divRplyFwdMsg">From: ', C("source"), "</div></div><p>after</p>")).alias("z"))
    return z.select("doc_id", F.get("z", F.lit(0)).alias("rule"), F.get("z", F.lit(1)).alias("body"), F.get("z", F.lit(2)).alias("quoted"))


# --- text -------------------------------------------------------------------

_MARK = "---------- Forwarded message ----------"


@query("documents", f"SELECT doc_id, kind, content FROM (SELECT doc_id, 'BODY' AS kind, 'intro ' || source AS content FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'FORWARD_HEADER', '{_MARK}' FROM documents UNION ALL SELECT doc_id, 'FORWARDED_BODY', 'fw ' || lang || ' ' || doc_id FROM documents)")
def text_forward_zones(t: DataFrame) -> DataFrame:
    mail = _s(F.when(C("doc_id") % 2 == 0, _s("intro ", C("source"), "\n")).otherwise(""), "\n", _MARK, " \n\nfw ", C("lang"), " ", C("doc_id"), "\n")
    return t.select("doc_id", F.explode(text.forward_zones(text.strip(mail))).alias("z")).select("doc_id", "z.kind", "z.content")


@query("conversations", "SELECT a.conv_id, a.turn, 'b' || a.turn AS body, CASE WHEN b.turn IS NOT NULL THEN 'On Monday X wrote:' || chr(10) || '> q' || b.turn END AS quoted FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def text_reply_zones(t: DataFrame) -> DataFrame:
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    mail = t.select("conv_id", "turn", F.when(before == C("turn") - 1, _s("b", C("turn"), "\n\nOn Monday X wrote:\n> q", before, "\n")).otherwise(_s("b", C("turn"))).alias("m"))
    z = mail.select("conv_id", "turn", text.reply_zones(C("m")).alias("z"))
    return z.select("conv_id", "turn", F.get("z", F.lit(0))["content"].alias("body"), F.get("z", F.lit(1))["content"].alias("quoted"))


@query("documents", "SELECT doc_id, trim('body ' || source) AS content FROM documents")
def zone_cleanup(t: DataFrame) -> DataFrame:
    tail = F.when(C("doc_id") % 2 == 0, "\n-- \nme\nphone").otherwise("\nDISCLAIMER: keep\nout")
    return t.select("doc_id", text.clean_zone(F.lit("BODY"), _s("body ", C("source"), tail), ALL).alias("content"))


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'rest' ELSE 'On x wrote: this' || chr(10) || 'rest' END AS content FROM documents")
def quoted_header_strip(t: DataFrame) -> DataFrame:
    return t.select("doc_id", text.clean_zone(F.lit("QUOTED"), _s(F.when(C("doc_id") % 2 == 0, "On Tue Me Wrote:").otherwise("On x wrote: this"), "\nrest"), ALL).alias("content"))


@query("conversations", "SELECT conv_id, coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'user' AND trim(text) <> ''), string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS body FROM conversations GROUP BY conv_id")
def body_assemble(t: DataFrame) -> DataFrame:
    zone = F.struct("turn", F.when(C("role") == "user", "QUOTED").otherwise("BODY").alias("kind"), C("text").alias("content"))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(zone)).alias("z")).select("conv_id", text.body_of(C("z")).alias("body"))


# --- rendering --------------------------------------------------------------

_SLUG_SQL = "coalesce(nullif(trim(regexp_replace(strip_accents(replace(lower(trim(text)), 'ß', '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'email')"


@query("documents", f"SELECT doc_id, {_SLUG_SQL} AS slug FROM documents")
def slugify(t: DataFrame) -> DataFrame:
    return t.select("doc_id", names.slugify(_s("Re: FWD: ", C("text"))).alias("slug"))


# Names are given out in turn: each gets the first number that is free, and some look numbered already.
@query(
    "documents",
    """WITH RECURSIVE d AS (SELECT doc_id, lang, source || CASE doc_id % 5 WHEN 1 THEN '-2' WHEN 2 THEN '-3' WHEN 3 THEN '-2-2' ELSE '' END AS name, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn, source FROM documents),
    f AS (SELECT doc_id, lang, source, rn, name, name AS final, [name] AS used FROM d WHERE rn = 1
      UNION ALL SELECT x.doc_id, x.lang, x.source, x.rn, x.name, x.final, list_append(x.before, x.final) FROM (
        SELECT d.doc_id, d.lang, d.source, d.rn, d.name, f.used AS before, list_filter(list_transform(range(1, len(f.used) + 3), lambda k: CASE WHEN k = 1 THEN d.name ELSE d.name || '-' || k END), lambda c: NOT list_contains(f.used, c))[1] AS final
        FROM f JOIN d ON d.lang = f.lang AND d.source = f.source AND d.rn = f.rn + 1) x)
    SELECT doc_id, name, final AS final_name FROM f""",
)
def slug_collision(t: DataFrame) -> DataFrame:
    k = C("doc_id") % 5
    name = _s(C("source"), F.when(k == 1, "-2").when(k == 2, "-3").when(k == 3, "-2-2").otherwise(""))
    return names.numbered(t.select("doc_id", "lang", name.alias("name")), folder="lang", name="name", order="doc_id").select("doc_id", "name", "final_name")


@query("pages", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/in/d' || page_id % 7 || '/n.md' WHEN 1 THEN '/out/exact.md' ELSE '/out/n.md' END AS target FROM pages")
def output_mirror_path(t: DataFrame) -> DataFrame:
    out = F.when(C("page_id") % 3 == 1, "/out/exact.md").when(C("page_id") % 3 == 2, "/out")
    return t.select("page_id", names.output_target(_s("/in/d", C("page_id") % 7, "/m.eml"), F.lit("n"), out).alias("target"))


_FRONT = "source string, subject string, sender string, date string, attachments array<string>, calendar array<string>, body string"


def _result_rows(t: DataFrame) -> DataFrame:
    calendar = F.when(C("doc_id") % 2 == 0, F.array(F.lit("Talk"))).otherwise(F.array().cast("array<string>"))
    row = F.struct(_s(C("source"), ".eml").alias("source"), _s("s", C("doc_id")).alias("subject"), F.lit("a@b.c").alias("sender"), F.lit(None).cast("string").alias("date"), F.array().cast("array<string>").alias("attachments"), calendar.alias("calendar"), F.coalesce("text", F.lit("")).alias("body"))
    return t.select("doc_id", row.alias("row"))


def _of_row(f: Callable[[dict], str]) -> Callable[[Column], Column]:
    """A vectorised UDF of a function of a result row."""
    return by_row(f, "string")


@query("documents", """SELECT doc_id, '{"source": "' || source || '.eml", "subject": "s' || doc_id || '", "sender": "a@b.c", "date": null, "attachments": []' || CASE WHEN doc_id % 2 = 0 THEN ', "calendar": ["Talk"]' ELSE '' END || '}' AS front FROM documents""")
def front_matter_json(t: DataFrame) -> DataFrame:
    return _result_rows(t).select("doc_id", _of_row(lambda r: json.dumps(convert.front_matter(r)))(C("row")).alias("front"))


@query("documents", r"SELECT doc_id, md5('---' || chr(10) || 'source: ' || source || '.eml' || chr(10) || 'subject: s' || doc_id || chr(10) || 'sender: a@b.c' || chr(10) || 'date: null' || chr(10) || 'attachments: []' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'calendar:' || chr(10) || '- Talk' || chr(10) ELSE '' END || '---' || chr(10) || CASE WHEN b <> '' THEN chr(10) || b || chr(10) ELSE '' END) AS document_md5 FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS b FROM documents)")
def document_serialize(t: DataFrame) -> DataFrame:
    return _result_rows(t).select("doc_id", F.md5(_of_row(convert.document)(C("row")).cast("binary")).alias("document_md5"))


@query("events", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ', x (' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00 -> ' || strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00)' WHEN 1 THEN event_type || ', x (' || strftime(ts, '%Y-%m-%d') || ')' ELSE '(no summary)' END AS summary FROM events")
def calendar_summary(t: DataFrame) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    k = C("event_id") % 3
    head = F.when(k < 2, _s("SUMMARY:", C("event_type"), "\\,\r\n  x\r\n")).otherwise("")
    times = F.when(k == 0, _s("DTSTART:", stamp(C("ts")), "\r\nDTEND:", stamp(F.timestamp_add("HOUR", F.lit(1), C("ts"))), "\r\n")).when(k == 1, _s("DTSTART;VALUE=DATE:", F.date_format("ts", "yyyyMMdd"), "\r\n")).otherwise("")
    part = _s("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\n", head, times, "END:VEVENT\r\nEND:VCALENDAR\r\n")
    return t.select("event_id", F.get(calendar_summaries(F.array(part)), F.lit(0)).alias("summary"))


# --- diagnostics, reports, jobs ---------------------------------------------


@query(
    "documents",
    """SELECT doc_id, CASE WHEN html AND ruled THEN 'html' WHEN NOT html THEN 'plain_fallback' WHEN NOT failed THEN CASE WHEN blank OR quoted THEN 'plain_fallback' ELSE 'html' END
      WHEN repaired THEN CASE WHEN blank OR quoted THEN 'plain_fallback' ELSE 'html' END ELSE 'plain_fallback' END AS path,
    CASE WHEN html AND ruled THEN 'high' WHEN NOT html THEN 'medium' WHEN NOT failed AND NOT blank AND quoted THEN 'low' WHEN NOT failed THEN 'medium' WHEN repaired THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN html AND ruled THEN NULL WHEN NOT html THEN 'plain_text_reply_parser' WHEN NOT failed AND blank THEN NULL WHEN NOT failed AND quoted THEN 'plain_text_reply_parser' WHEN NOT failed THEN NULL
      WHEN repaired AND blank THEN NULL WHEN repaired THEN 'html_markdown_panic_repaired' ELSE 'html_failure_plain_text_fallback' END AS fallback,
    CASE WHEN (html AND ruled) OR NOT html OR (NOT failed AND NOT (quoted AND NOT blank)) THEN 'normal' WHEN NOT failed OR NOT repaired THEN 'review_recommended' ELSE 'degraded' END AS state,
    CASE WHEN (html AND ruled) OR NOT html OR (NOT failed AND NOT (quoted AND NOT blank)) THEN 'pass' ELSE 'review' END AS grade
    FROM (SELECT doc_id, doc_id % 2 = 0 AS html, (doc_id // 2) % 2 = 0 AND (doc_id // 4) % 2 = 1 AS ruled, (doc_id // 4) % 2 = 0 AS failed, (doc_id // 8) % 2 = 0 AS repaired, (doc_id // 16) % 2 = 0 AS blank, (doc_id // 32) % 2 = 0 AS quoted FROM documents)""",
)
def diagnostics_matrix(t: DataFrame) -> DataFrame:
    bit = lambda n: F.floor(C("doc_id") / n) % 2 == 0
    kind, failed = F.when(bit(1), "html").otherwise("plain"), bit(4)
    patterns = F.when(bit(32), F.array(F.lit("gmail"))).otherwise(F.array().cast("array<string>"))
    d = diagnostics.decision(kind, F.when(bit(2) & ~failed, "gmail_quote"), failed, bit(8), bit(16), patterns, F.lit(False), True)
    rows = t.select("doc_id", d.alias("d")).select("doc_id", "d.path", "d.confidence", "d.fallback", diagnostics.quality_state(C("d.confidence"), C("d.warning").isNotNull().cast("int")).alias("state"))
    return rows.withColumn("grade", diagnostics.grade(F.lit("succeeded"), C("state")))


@query("documents", "SELECT source, count(*) AS total, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 2 = 0) AS written, count(*) FILTER (WHERE doc_id % 3 > 0 AND doc_id % 2 = 1) AS skipped, count(*) FILTER (WHERE doc_id % 3 = 0) AS errors, CASE WHEN count(*) FILTER (WHERE doc_id % 3 = 0) = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE doc_id % 3 > 0) = 0 THEN 'failed' ELSE 'completed_with_errors' END AS status FROM documents GROUP BY source")
def report_summary(t: DataFrame) -> DataFrame:
    n = reports.counters(C("doc_id") % 3 > 0, F.when(C("doc_id") % 2 == 0, C("source")))
    return t.groupBy("source").agg(*(c.alias(k) for k, c in n.items())).withColumn("status", reports.report_status(C("written") + C("skipped"), C("errors")))


@query("documents", "SELECT doc_id, source || lang AS clean FROM documents")
def report_sanitize(t: DataFrame) -> DataFrame:
    return t.select("doc_id", reports.safe_text(_s(C("source"), "\0", C("lang"))).alias("clean"))


_JOBS_SQL = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'running' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 50 AS BIGINT)) END AS finished_at FROM orders)"


def _jobs(t: DataFrame) -> DataFrame:
    status = F.when(C("o_orderstatus") == "F", "failed").when(C("o_orderstatus") == "O", "succeeded").otherwise("running")
    finished = F.when(C("o_orderkey") % 3 > 0, F.timestamp_add("HOUR", C("o_orderkey") % 50, C("o_orderdate")))
    return t.select(C("o_orderkey").alias("id"), status.alias("status"), C("o_orderdate").alias("created_at"), finished.alias("finished_at"))


@query("orders", f"SELECT id, status FROM {_JOBS_SQL} WHERE status <> 'running' ORDER BY coalesce(finished_at, created_at) DESC, created_at DESC, id DESC LIMIT 50")
def job_history_topk(t: DataFrame) -> DataFrame:
    return reports.history(_jobs(t)).select("id", "status")


@query("orders", f"SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'succeeded') AS succeeded FROM {_JOBS_SQL} WHERE status <> 'running'")
def job_history_totals(t: DataFrame) -> DataFrame:
    return reports.history_totals(_jobs(t))


@query("events", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, ['queued', 'running', 'succeeded', 'failed', 'cancelled'][1 + event_id % 5] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, rn, CASE WHEN status = 'queued' THEN status END AS s, NULL::BIGINT AS a, NULL::BIGINT AS z FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.rn, CASE WHEN ok THEN status ELSE s END, CASE WHEN ok AND status = 'running' THEN coalesce(a, us) ELSE a END, CASE WHEN ok AND status IN ('succeeded', 'failed', 'cancelled') THEN us ELSE z END
      FROM (SELECT f.s, f.a, f.z, e.*, coalesce((f.s IS NULL AND e.status = 'queued') OR (f.s = 'queued' AND e.status IN ('running', 'cancelled')) OR (f.s = 'running' AND e.status IN ('succeeded', 'failed', 'cancelled')), false) AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) e)
    SELECT user_id, s AS status, a AS started_us, z AS finished_us FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1""")
def job_lifecycle(t: DataFrame) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "cancelled"))), (C("event_id") % 5).cast("int"))
    rows = reports.lifecycle(t.withColumn("status", status), job="user_id", at=["ts", "event_id"], status="status")
    us = lambda c: F.unix_micros(C(c).cast("timestamp"))
    return rows.select("user_id", "status", us("started_at").alias("started_us"), us("finished_at").alias("finished_us"))


@query("lineitem", "SELECT l_orderkey, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok AND NOT dry) AS written, count(*) FILTER (WHERE ok AND dry) AS skipped, count(*) FILTER (WHERE NOT ok) AS errors FROM (SELECT l_orderkey, l_returnflag <> 'R' AS ok, l_orderkey % 2 = 0 AS dry FROM lineitem) GROUP BY 1")
def job_counters(t: DataFrame) -> DataFrame:
    return t.groupBy("l_orderkey").agg(*(c.alias(k) for k, c in reports.worker_counters(C("l_returnflag") != "R", C("l_orderkey") % 2 == 0).items()))


@query("orders", f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY coalesce(finished_at, created_at) DESC, created_at DESC, id DESC) AS rn FROM {_JOBS_SQL} WHERE status <> 'running') WHERE rn > 2000")
def job_prune(t: DataFrame) -> DataFrame:
    return reports.surplus(_jobs(t)).select("id")


@query("lineitem", "SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'cancelled' WHEN e > 0 AND l_orderkey % 2 = 0 THEN 'failed' WHEN e > 0 THEN 'completed_with_errors' ELSE 'succeeded' END AS status FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS e FROM lineitem GROUP BY 1)")
def job_terminal_status(t: DataFrame) -> DataFrame:
    n = t.groupBy("l_orderkey").agg(F.count_if(C("l_returnflag") == "R").alias("e"))
    return n.select("l_orderkey", reports.job_status(C("l_orderkey") % 11 == 0, F.when(C("l_orderkey") % 2 == 0, "file").otherwise("directory"), C("e")).alias("status"))


@query("events", "SELECT event_id, before, coalesce((before IS NULL AND status = 'queued') OR (before = 'queued' AND status IN ('running', 'cancelled')) OR (before = 'running' AND status IN ('succeeded', 'failed', 'cancelled')), false) AS allowed FROM (SELECT event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, ['queued', 'running', 'succeeded', 'failed', 'cancelled'][1 + event_id % 5] AS status FROM events))")
def job_transition_check(t: DataFrame) -> DataFrame:
    status = F.get(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "cancelled"))), (C("event_id") % 5).cast("int"))
    return reports.transitions(t.withColumn("status", status), job="user_id", at=["ts", "event_id"], status="status").select("event_id", "before", "allowed")


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 < 3 AND doc_id % 7 > 2 THEN 'retry_with_html_repair' WHEN doc_id % 11 < 6 AND doc_id % 13 > 3 THEN 'retry_with_html_fallback' END END AS action FROM documents")
def recovery_actions(t: DataFrame) -> DataFrame:
    i = C("doc_id")
    a = reports.recovery_action(F.when(i % 3 == 0, "html_markdown_failed"), F.when(i % 2 == 0, "file").otherwise("directory"), i % 5 < 3, i % 7 <= 2, i % 11 < 6, i % 13 <= 3)
    return t.select("doc_id", a.alias("action"))


@query(
    "events",
    "WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS rn FROM events), f AS (SELECT user_id, event_id, rn, sec AS kept, true AS fresh FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.sec - f.kept >= 21600 THEN e.sec ELSE f.kept END, e.sec - f.kept >= 21600 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1) SELECT event_id, fresh FROM f",
)
def watch_dedupe(t: DataFrame) -> DataFrame:
    at = F.unix_seconds(F.date_trunc("second", C("ts").cast("timestamp")))

    return dedupe(t.select("user_id", "event_id", at.alias("at")), key=["user_id"], at="at", order="event_id", gap=21600).select("event_id", "fresh")


@query("pages", "SELECT page_id, row_number() OVER (ORDER BY page_id % 5 <> 0, lower(url), page_id) AS place FROM pages")
def fs_listing_sort(t: DataFrame) -> DataFrame:
    rows = t.select("page_id", "url", F.when(C("page_id") % 5 == 0, "directory").otherwise("file").alias("type"))
    return placed(rows, "type", "url", "page_id").select("page_id", C("place").cast("long").alias("place"))


@query("documents", "SELECT doc_id, doc_id % 3 < 2 AND doc_id % 2 = 0 AS watched FROM documents")
def eml_filter(t: DataFrame) -> DataFrame:
    path = _s(F.when(C("doc_id") % 2 == 0, "/in/a").otherwise("/in/_batch-1/a"), C("doc_id"), F.get(F.array(F.lit(".eml"), F.lit(".EML"), F.lit(".txt")), (C("doc_id") % 3).cast("int")))
    return t.select("doc_id", is_message(path).alias("watched"))


@query("documents", "SELECT doc_id % 2 = 0 AS is_eml, count(*) AS files, sum(n_chars)::BIGINT AS bytes, sum(n_chars) > 104857600 AS large FROM documents GROUP BY 1")
def drop_summary(t: DataFrame) -> DataFrame:
    files = t.select(F.when(C("doc_id") % 2 == 0, "a.EML").otherwise("eml.txt").alias("name"), C("n_chars").alias("size"))
    return drop_split(files)


# --- values for a user interface --------------------------------------------


@query("lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.1fs', ms / 1000.0) END AS duration FROM (SELECT *, ((l_orderkey * 37 + l_linenumber * 250) * 2 + 1) % 5000 AS ms FROM lineitem)")
def ui_duration(t: DataFrame) -> DataFrame:
    return t.select("l_orderkey", "l_linenumber", ui.duration(((C("l_orderkey") * 37 + C("l_linenumber") * 250) * 2 + 1) % 5000).alias("duration"))


@query("events", "SELECT event_id, CASE WHEN s < -30 THEN '' WHEN s < 10 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago FROM (SELECT event_id, (event_id * event_id) % 200000 - 60 AS s FROM events)")
def ui_relative_time(t: DataFrame) -> DataFrame:
    return t.select("event_id", ui.relative_time((C("event_id") * C("event_id")) % 200000 - 60).alias("ago"))


@query("documents", "SELECT doc_id, CASE WHEN a + b = 0 THEN '' ELSE concat_ws(', ', CASE WHEN a > 0 THEN a || ' signature image' || CASE WHEN a <> 1 THEN 's' ELSE '' END END, CASE WHEN b > 0 THEN b || ' tracking pixel' || CASE WHEN b <> 1 THEN 's' ELSE '' END END) || ' stripped' END AS summary FROM (SELECT doc_id, doc_id % 3 AS a, doc_id % 4 AS b FROM documents)")
def ui_stripped_summary(t: DataFrame) -> DataFrame:
    return t.select("doc_id", ui.stripped_summary(C("doc_id") % 3, C("doc_id") % 4).alias("summary"))


@query("lineitem", "SELECT l_orderkey, round(least(greatest(t, 1), c + f) / greatest(t, 1), 9) AS part, (c + f) || ' / ' || t AS label FROM (SELECT l_orderkey, count(*) AS t, count(*) FILTER (WHERE l_returnflag = 'N') AS c, count(*) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)")
def ui_progress(t: DataFrame) -> DataFrame:
    n = t.groupBy("l_orderkey").agg(F.count("*").alias("t"), F.count_if(C("l_returnflag") == "N").alias("c"), F.count_if(C("l_returnflag") == "R").alias("f"))
    return n.select("l_orderkey", F.round(ui.progress(C("c"), C("f"), C("t")), 9).alias("part"), ui.progress_label(C("c"), C("f"), C("t")).alias("label"))


@query("documents", "SELECT doc_id, CASE WHEN (doc_id % 2 = 0) AND (doc_id % 3 = 0) THEN 'all' WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'some' ELSE 'none' END AS state FROM documents")
def ui_flags_state(t: DataFrame) -> DataFrame:
    return t.select("doc_id", ui.flags_state(C("doc_id") % 2 == 0, C("doc_id") % 3 == 0).alias("state"))


@query("documents", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '.hidden' WHEN 2 THEN '—' ELSE 'a.b' END AS name, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'err' END AS color, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'neutral' END AS class, CASE doc_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'degraded' ELSE 'Unavailable' END AS label FROM documents")
def ui_labels(t: DataFrame) -> DataFrame:
    k, j = C("doc_id") % 4, C("doc_id") % 3
    path = F.when(k == 0, _s("/c/", C("source"), ".md")).when(k == 1, "\\c\\.hidden").when(k == 2, "/c/").otherwise("a.b.c")
    status = F.when(j == 0, "succeeded").when(j == 1, "completed_with_errors").otherwise("failed")
    state = F.when(j == 0, "normal").when(j == 1, "degraded")
    return t.select("doc_id", ui.display_name(path).alias("name"), ui.status_color(status).alias("color"), ui.state_class(state).alias("class"), ui.state_label(state).alias("label"))


@query("documents", "SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'Input path is required.' END, CASE WHEN doc_id % 3 = 0 THEN 'Mode must be file or directory.' END) AS problems FROM documents")
def ui_validate_form(t: DataFrame) -> DataFrame:
    return t.select("doc_id", ui.form_error(F.when(C("doc_id") % 3 == 0, "x").otherwise("file"), F.when(C("doc_id") % 2 == 0, "  ").otherwise("p")).alias("problems"))


# Whole texts, in turn as a plain mail with a signature, and as what two clients and one that is not known quote in HTML. Text that looks like markup or a quote is made harmless.
@query(
    "documents",
    r"""SELECT doc_id, 's' || doc_id AS subject, 's' || doc_id AS slug, true AS success,
    CASE WHEN k = 0 THEN md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) ELSE md5('reply ' || doc_id) END AS body_md5,
    CASE WHEN k IN (1, 2) THEN 'html' ELSE 'plain_fallback' END AS path, ['generic', 'gmail', 'outlook', 'generic'][k + 1] AS hint, ['normal', 'normal', 'normal', 'review_recommended'][k + 1] AS state,
    CASE WHEN k IN (1, 2) THEN 'client_hint' WHEN k = 3 THEN 'quote_patterns' ELSE '' END AS known, CASE WHEN k = 0 THEN 1 ELSE 2 END AS zones
    FROM (SELECT doc_id, doc_id % 4 AS k, 'x ' || regexp_replace(coalesce(text, ''), '[<>&]', '.', 'g') AS t FROM documents)""",
)
def convert_messages(t: DataFrame) -> DataFrame:
    i, k = C("doc_id"), C("doc_id") % 4
    text_ = F.concat(F.lit("x "), F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", "."))
    quote = F.when(k == 1, _s('<div class="gmail_quote">', text_, "</div>")).when(k == 2, _s('<div id="divRplyFwdMsg">', text_, "</div>")).otherwise(_s("<blockquote>", text_, "</blockquote>"))
    body = F.when(k == 0, F.concat(text_, F.lit("\n-- \nsig"))).otherwise(_s("<p>reply ", i, "</p>", quote))
    head = _s("From: a@b.c\r\nSubject: s", i, "\r\nContent-Type: text/", F.when(k == 0, "plain").otherwise("html"), "; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n")
    done = convert.convert_df(t.select(i.cast("string").alias("path"), F.concat(head, body).cast("binary").alias("content")), ConvertOptions(strip_signatures=True))
    d = C("diagnostics")
    return done.select(
        C("source").cast("long").alias("doc_id"), "subject", "slug", "success", F.md5(C("body").cast("binary")).alias("body_md5"), d["segmentation_path"].alias("path"), d["client_hint"].alias("hint"), d["state"].alias("state"),
        F.array_join(F.map_keys(F.get("zones", F.lit(0))["metadata"]), ",").alias("known"), F.size("zones").alias("zones"),
    )


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'normal' WHEN doc_id % 3 = 1 THEN 'degraded' END AS state, CASE WHEN doc_id % 3 < 2 THEN doc_id % 2 END AS warnings, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || ': broken' ELSE '' END AS error FROM documents")
def ui_normalize_json(t: DataFrame) -> DataFrame:
    state = F.when(C("doc_id") % 3 == 0, "normal").when(C("doc_id") % 3 == 1, "degraded").otherwise("other")
    raw = _s('{"state":"', state, '"', F.when(C("doc_id") % 2 == 1, ',"warnings":[{"code":"c","message":"m","severity":"warning"}]').otherwise(""), "}")
    errors = F.when(C("doc_id") % 2 == 0, _s('[{"path":"f', C("doc_id"), '","code":"c","message":"broken"}]')).otherwise("[]")
    d = ui.normalized_diagnostics(raw)
    return t.select("doc_id", d["state"].alias("state"), F.when(d.isNotNull(), F.size(d["warnings"])).cast("long").alias("warnings"), ui.first_error(errors).alias("error"))
