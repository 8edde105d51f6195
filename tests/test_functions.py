"""The functions behind the UDFs, without Spark."""

from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.functions import calendar, html, mime, names, text
from postmill.operators.convert import document, html_stage, rewrite_images
from postmill.options import ConvertOptions, options_from_preset

PIECES = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class=x id=y>", "</div>", "<script>a", "</script>", "<ul><li>", "</ul>", "<a href='javascript:x'>", "<a href=http://e>", "</a>", "text & more", "<!-- c -->", "<br>", "<table><tr><td>", "</table>", "<i>", "é"]), max_size=20)


@given(PIECES)
@settings(max_examples=150, deadline=None)
def test_sanitizing_is_idempotent_and_total(pieces):
    clean = html.sanitize("".join(pieces))
    assert html.sanitize(clean) == clean
    assert "<script" not in clean and "javascript:" not in clean and "<!--" not in clean
    html.markdown(clean)
    html.segment(clean)


def test_sanitize_keeps_what_is_allowed():
    assert html.sanitize('<a href="javascript:x" title="t">l</a>') == '<a title="t" rel="noopener noreferrer">l</a>'
    assert html.sanitize("<section><p onclick=x>a</section>") == "<p>a</p>"
    assert html.sanitize('<img src="cid:a" width="1">') == '<img src="cid:a">'


def test_markdown_subset():
    assert html.markdown("<h2>T</h2><p>a <b>b</b> <em>c</em></p>") == "## T\n\na **b** *c*"
    assert html.markdown("<ul><li>x<ul><li>y</ul></ul>") == "- x\n  - y"
    assert html.markdown("<blockquote><p>a</p><p>b</p></blockquote>") == "> a\n>\n> b"
    assert html.markdown("<pre>a\n b</pre>") == "```\na\n b\n```"
    assert html.markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_quotes_and_segments():
    assert html.quote_patterns('<hr style="border-top:solid #E1E1E1">') == ["outlook"]
    assert html.quote_patterns('<span class="gmail_quote">q</span>') == []
    rule, zones = html.segment('<div>a</div><div class="gmail_quote">q</div>z')
    assert rule == "gmail_quote" and [z["kind"] for z in zones] == ["BODY", "QUOTED"] and zones[0]["content"] == "<div>a</div>z"
    rule, zones = html.segment('<table><tr><td>a<div id="divRplyFwdMsg">q</div></td></tr></table><p>after</p>')
    assert rule == "outlook_divRplyFwdMsg" and "after" in zones[1]["content"] and "after" not in zones[0]["content"]


def test_image_layers():
    page = '<div class="moz-signature"><img src="s.png"></div><img src="t.png"><p>x</p><img src="u.png"><img src="https://e/logo.png"><img src="v" width=1 height=1><img src="cid:w" width=1 height=1>'
    clean, gone = html.filter_images(page, signatures=True, pixels=True)
    assert [(g["reference"], g["reason"]) for g in gone] == [("s.png", "thunderbird_signature_wrapper"), ("t.png", "structural_boundary_extension"), ("https://e/logo.png", "filename_pattern:logo"), ("v", "dimension_heuristic")]
    assert 'src="u.png"' in clean and 'src="cid:w"' in clean
    assert html.filter_images(page, signatures=False, pixels=False) == (page, [])


def test_mime_shapes():
    assert mime.parse(b"")["selected_body_kind"] is None and mime.parse(None)["sender"] == "unknown"
    both = b"From: A <a@b.c>\r\nContent-Type: multipart/alternative; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\np\r\n--x\r\nContent-Type: text/html\r\n\r\n<p>h</p>\r\n--x--\r\n"
    got = mime.parse(both)
    assert (got["selected_body_kind"], got["html_body"], [c["kind"] for c in got["body_candidates"]]) == ("html", "<p>h</p>", ["html", "plain"])
    assert mime.parse(b"Content-Type: text/plain; charset=iso-8859-1\r\n\r\ncaf\xe9")["text_body"] == "café"
    assert mime.parse(b"Content-Type: text/plain; charset=nonsense\r\n\r\nok")["text_body"] == "ok"
    assert mime.clean_filename("../a\\b/c.txt") == "c.txt" and mime.clean_filename("..") == "attachment" and mime.clean_filename(" ") == ""
    assert mime.iso_date("Tue, 1 Jul 2025 10:00:00 +0200") == "2025-07-01T10:00:00+02:00" and mime.iso_date("never") is None


def test_replies_slugs_calendar():
    kinds = lambda t: [(z["kind"], z["content"]) for z in text.split_replies(t)]
    assert kinds("Hi\n\nOn Mon, A\n<a@b.c> wrote:\n> old") == [("BODY", "Hi"), ("QUOTED", "On Mon, A\n<a@b.c> wrote:\n> old")]
    assert kinds("just text") == [("BODY", "just text")] and kinds(" ") == []
    assert names.slug("Re: fwd: Ünïcode  ﬁne ß!") == "unicode-fine" and names.slug("Re:") == "email"
    event = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:A\\, b\nDTSTART;TZID=Europe/Paris:20250701T100000\nEND:VEVENT\nEND:VCALENDAR"
    assert calendar.summaries([event, "broken", None]) == ["A, b (2025-07-01T10:00:00+02:00)"]


def test_options_failure_and_documents(monkeypatch):
    assert options_from_preset("clean", strip_signatures=False) == ConvertOptions(strip_disclaimers=True, strip_quoted_headers=True, strip_tracking_pixels=True, strip_signature_images=True, allow_fallback_on_html_error=True, allow_html_repair_on_panic=True)
    assert options_from_preset("nonsense") == options_from_preset("default")
    assert rewrite_images("![a](cid:x) b ![](cid:y)", {"y": "data:z"}, {"x"}) == "b ![](data:z)"
    real = html.markdown
    monkeypatch.setattr(html, "markdown", lambda h: (_ for _ in ()).throw(ValueError()) if "<i>" in h else real(h))
    assert html_stage("<p><i>x</i></p>", {}, ConvertOptions())["failed"]
    fixed = html_stage("<p><i>x</i></p>", {}, ConvertOptions(allow_html_repair_on_panic=True))
    assert fixed["failed"] and fixed["repaired"] and fixed["markdown"] == "x"
    row = {"source": "s", "subject": "é", "sender": "a", "date": None, "attachments": [], "body": "b"}
    assert document(row) == "---\nsource: s\nsubject: é\nsender: a\ndate: null\nattachments: []\n---\n\nb\n"
