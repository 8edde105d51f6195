"""Exports, tools, command line, jobs, reports, names on disk and rules behind single messages."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

import postmill
from postmill import __main__ as cli
from postmill import tools
from postmill.functions import html, mime, names
from postmill.operators import convert, jobs, sinks
from postmill.options import ConvertOptions
from postmill.streaming import watch

MAIL = "From: A <a@b.c>\r\nSubject: {}\r\n\r\n{}\r\n"


def mail(folder, name, subject, body="hello"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(MAIL.format(subject, body))
    return path


def test_package_functions(spark, tmp_path):
    source = mail(str(tmp_path / "in"), "a.eml", "Hi there")
    one = postmill.convert(source, output=tmp_path / "out")
    assert isinstance(one, postmill.ConvertResult) and one.success and one.output.name == "hi-there.md" and one.sender == "a@b.c"
    assert [r.output.name for r in postmill.convert_dir(tmp_path / "in", output=tmp_path / "out")] == ["hi-there-2.md"]
    made = postmill.convert_to_bundle(source, bundle_root=tmp_path / "cab", source_handling="copy")
    assert isinstance(made, postmill.BundleResult) and made.markdown.exists() and made.source_artifact.exists() and set(postmill.__all__) >= {"ConvertOptions"}
    for wrong, kind in ((tmp_path / "none.eml", FileNotFoundError), (made.markdown, ValueError)):
        with pytest.raises(kind):
            postmill.convert(wrong)
    with pytest.raises(FileNotFoundError):
        postmill.convert_dir(tmp_path / "nowhere")
    with pytest.raises(ValueError):
        postmill.convert_dir(source)


def test_tools(spark, tmp_path):
    source = mail(str(tmp_path / "in"), "a.eml", "Tool", "body\n-- \nsig")
    assert tools.convert_eml(source).endswith("---\n\nbody\n") and "sig" in tools.convert_eml(source, preset="raw")
    assert "sig" in tools.convert_eml(source, str(tmp_path / "o.md"), strip_signatures=False) and (tmp_path / "o.md").exists()
    bundle = json.loads(tools.convert_eml_to_bundle(source, str(tmp_path / "cab")))
    assert os.path.exists(bundle["markdown_path"]) and bundle["diagnostics"]["state"] == "normal" and os.path.exists(source)
    summary = json.loads(tools.convert_directory(str(tmp_path / "in"), str(tmp_path / "out")))
    assert (summary["total"], summary["successes"], summary["failures"], len(summary["output_paths"]), summary["errors"]) == (1, 1, 0, 1, [])
    assert json.loads(tools.get_diagnostics(source))["selected_body"] == "plain" and os.listdir(tmp_path / "in") == ["a.eml"]
    with pytest.raises(FileNotFoundError):
        tools.convert_eml(str(tmp_path / "no.eml"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    mail(str(tmp_path / "in"), "d/a.eml", "Cli", "body\n-- \nsig")
    out = str(tmp_path / "out")
    assert cli.main([str(tmp_path / "in"), "--output", out, "--strip-signatures", "--report"]) == 0
    report = json.load(open(os.path.join(out, ".postmill-report.json")))
    assert report["results"][0]["source"] == "d/a.eml" and report["results"][0]["output"] == "d/cli.md" and "sig" not in open(os.path.join(out, "d/cli.md")).read()
    assert report["options"]["strip_signatures"] and "report" not in report["options"]
    assert cli.main([str(tmp_path / "gone.eml")]) == 1
    args = cli.parser().parse_args(["convert", "x", "--delete-eml", "--dry-run"])
    assert cli.chosen(args) == ConvertOptions(dry_run=True) and cli.chosen(cli.parser().parse_args(["convert", "x", "--preset", "raw"])).allow_html_repair_on_panic
    monkeypatch.setenv("POSTMILL_SETTINGS", str(tmp_path / "s.json"))
    capsys.readouterr()
    assert cli.main(["doctor", "--json"]) == 0
    rows = {r["name"]: r["status"] for r in json.loads(capsys.readouterr().out)}
    assert rows["core_dependencies"] == "ok" and rows["inbox_path"] == rows["cabinet_path"] == "skip"
    jobs.save_settings(str(tmp_path / "s.json"), str(tmp_path / "i"), str(tmp_path / "c"))
    assert {r["name"]: r["status"] for r in cli.checks()}["cabinet_path"] == "ok" and jobs.load_settings(str(tmp_path / "s.json"))["inbox_path"] == str(tmp_path / "i")
    os.rmdir(tmp_path / "i")
    assert {r["name"]: r["status"] for r in cli.checks()}["inbox_path"] == "err"


def test_no_file_is_ever_replaced(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, subject in (("a.eml", "a-2"), ("b.eml", "a-2"), ("c.eml", "a-2-2"), ("d.eml", "a"), ("e.eml", "a")):
        mail(inbox, name, subject, f"from {name}")
    first = sinks.convert_dir(spark, inbox, output=out)
    assert [os.path.basename(r["output"]) for r in first] == ["a-2.md", "a-2-2.md", "a-2-2-2.md", "a.md", "a-3.md"]
    before = {n: open(os.path.join(out, n)).read() for n in os.listdir(out)}
    second = sinks.convert_dir(spark, inbox, output=out)
    assert len({r["output"] for r in first + second}) == 10 and all(r["success"] for r in second)
    assert all(open(os.path.join(out, n)).read() == t for n, t in before.items())
    assert sinks.write_new(os.path.join(out, "x.md"), b"1") == sinks.write_new(os.path.join(out, "x.md"), b"1", again=True)
    assert sinks.write_new(os.path.join(out, "x.md"), b"1").endswith("x-2.md") and not [n for n in os.listdir(out) if n.startswith(".postmill")]


def test_sources_are_deleted_only_after_their_documents_are_there(spark, tmp_path, monkeypatch):
    inbox = str(tmp_path / "in")
    for k in range(3):
        mail(inbox, f"{k}.eml", "Same", f"text {k}")
    real = os.unlink
    monkeypatch.setattr(os, "unlink", lambda p: (_ for _ in ()).throw(PermissionError(p)) if str(p).endswith("1.eml") else real(p))
    done = sinks.convert_dir(spark, inbox, output=str(tmp_path / "out"), options=ConvertOptions(delete_eml=True))
    assert [r["success"] for r in done] == [True, False, True] and os.listdir(inbox) == ["1.eml"]
    texts = sorted(open(os.path.join(tmp_path, "out", n)).read().split()[-1] for n in os.listdir(tmp_path / "out"))
    assert texts == ["0", "2"] and done[1]["output"] is None


def in_turn(rows, taken=()):
    used, out = set(taken), {}
    for key, folder, name in sorted(rows):
        k = 1
        while (folder, c := name if k == 1 else f"{name}-{k}") in used:
            k += 1
        used.add((folder, c))
        out[key] = c
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_numbers_are_given_in_turn(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice("xy"), r.choice(["a", "a-2", "a-2-2", "a-3", "b", "c-7", "a-b"])) for k in range(80)]
    taken = [("x", "b"), ("y", "a-2"), ("x", "c-7-2")]
    df = spark.createDataFrame(rows, "k int, f string, n string").repartition(5)
    there = spark.createDataFrame(taken, "f string, n string")
    assert {x.k: x.final_name for x in names.numbered(df, folder="f", name="n", order="k").collect()} == in_turn(rows)
    assert {x.k: x.final_name for x in names.numbered(df, folder="f", name="n", order="k", existing=there).collect()} == in_turn(rows, taken)


def test_names_run_out(spark, monkeypatch):
    monkeypatch.setattr(names, "MOST_SUFFIXES", 3)
    df = spark.createDataFrame([(k, "f", "a") for k in range(5)], "k int, f string, n string")
    assert [x.final_name for x in names.numbered(df, folder="f", name="n", order="k").orderBy("k").collect()] == ["a", "a-2", "a-3", None, None]


def test_jobs_run_report_and_stop(spark, tmp_path):
    inbox, cabinet = str(tmp_path / "in"), str(tmp_path / "cab")
    for k in range(2):
        mail(inbox, f"{k}.eml", "Job")
    runner = jobs.JobRunner(spark, cabinet, workers=1)
    job = runner.submit("directory", inbox, ConvertOptions(report=True))
    waiting = runner.submit("directory", inbox, ConvertOptions(dry_run=True))
    assert runner.cancel(waiting.id) is True and runner.cancel("none") is None
    done = runner.wait(job.id, 60)
    assert (done.status, done.total, done.completed, done.written, done.skipped) == ("succeeded", 2, 2, 2, 0) and done.started_at <= done.finished_at and not os.listdir(inbox)
    report = json.load(open(done.report_path))
    assert os.path.basename(done.report_path) == f".postmill-report-{done.id}.json" and report["job"]["id"] == done.id and sorted(r["output"] for r in report["results"]) == ["0", "1"]
    assert runner.wait(waiting.id, 60).status == "cancelled" and runner.cancel(waiting.id) is False and waiting.completed == 0
    mail(inbox, "9.eml", "Dry")
    dry = runner.wait(runner.submit("file", os.path.join(inbox, "9.eml"), ConvertOptions(dry_run=True)).id, 60)
    assert (dry.status, dry.skipped, dry.written) == ("succeeded", 1, 0)
    for mode, path in (("file", inbox), ("directory", os.path.join(inbox, "9.eml")), ("directory", cabinet), ("file", str(tmp_path / "x.eml"))):
        with pytest.raises(ValueError):
            runner.submit(mode, path)
    with pytest.raises(ValueError):
        done.move("running")
    assert sinks.bundle_error({"success": False, "source": "s", "error": "e"}) == {"path": "s", "code": "conversion_error", "message": "e", "stage": "core"}
    runner.close()


def test_reports_are_clean_and_relative(spark, tmp_path):
    rows = [{"source": str(tmp_path / "in/d/a.eml"), "output": str(tmp_path / "out/a.md"), "success": True, "diagnostics": {"b\0ad": "x\ud800"}, "error": None, "error_code": None}, {"source": "/else/b.eml", "output": None, "success": False, "diagnostics": None, "error": "no", "error_code": None}]
    report = sinks.build_report(spark, rows, ConvertOptions(), input_path=str(tmp_path / "in"), input_mode="directory", duration_ms=1, folder=str(tmp_path / "out"))
    assert [(r["source"], r["output"]) for r in report["results"]] == [("d/a.eml", "a.md"), ("b.eml", None)] and report["job"]["status"] == "completed_with_errors"
    assert report["results"][0]["diagnostics"] == {"bad": "x�"} and "error" in report["results"][1]
    with pytest.raises(ValueError):
        sinks.write_report(report, str(tmp_path), "x/y.json")


def test_watch_counts_failures(spark, tmp_path):
    inbox, status = str(tmp_path / "in"), watch.WatchStatus()
    mail(inbox, "a.eml", "Good")
    with open(os.path.join(inbox, "b.eml"), "w") as f:
        f.write("Content-Type: text/html\r\n\r\n<p>x</p>")
    mail(str(tmp_path / "else"), "c.eml", "Foreign")
    os.symlink(tmp_path / "else" / "c.eml", os.path.join(inbox, "c.eml"))
    got = []
    q = watch.watch(spark, inbox, lambda df, n: got.extend(x.subject for x in df.select("subject").collect()), checkpoint=str(tmp_path / "cp"), once=True, status=status)
    q.awaitTermination(60)
    assert sorted(got) == ["", "Good"] and (status.files_detected, status.failed_events) == (2, 0)

    def broken(df, n):
        raise OSError("disk")

    with pytest.raises(Exception):
        watch.watch(spark, inbox, broken, checkpoint=str(tmp_path / "cp2"), once=True, status=status).awaitTermination(60)
    assert status.failed_events == 1 and status.last_error["code"] == "watch_processing_error"


def test_single_message_rules():
    parsed = mime.parse(b"From: =?utf-8?q?Doe=2C_J?= <j@x.org>, B <b@x.org>\nContent-ID: <\xe9>\nContent-Type: multipart/mixed\n\nno parts")
    assert parsed["error"] is None and parsed["sender"] == "j@x.org" and parsed["defects"] and all(d["message"].endswith("Defect") for d in parsed["defects"])
    assert mime.parse(b"From: =?utf-8?q?Doe=2C_J?= <>\n\nx")["sender"] == "Doe, J"
    assert mime.parse(b"X-A: 1\nX-A: =?utf-8?q?=C3=A9?=\n\n")["headers"] == {"X-A": "1, é"}
    part = b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: application/x-text/calendar; name=c.ics\nContent-Transfer-Encoding: base64\n\nQkVHSU46VkNBTEVOREFS\n--b--\n"
    assert mime.parse(part)["calendar_parts"] == ["BEGIN:VCALENDAR"]
    for tiny in (("1", "1", ""), ("0", "", ""), ("", "1", ""), ("", "", "width:1px; HEIGHT : 0"), ("9", "", "height:1px;width:0"), ("1", "20", "height:1 !important")):
        assert html.tracking_reason("x", *tiny) == "dimension_heuristic"
    for not_tiny in (("1px", "1px", ""), (" 1", "", ""), ("1", "20", ""), ("", "", "max-width:1px;min-height:1px"), ("", "", "width:1px"), ("", "", "width:1em;height:1em")):
        assert html.tracking_reason("x", *not_tiny) is None
    assert html.tracking_reason("x", "", "", "visibility : HIDDEN") == "hidden_image" and html.tracking_reason("cid:x", "1", "1", "") is None


@pytest.mark.parametrize("tag", ["div", "b", "blockquote", "ul><li", "table><tr><td", "a href=x"])
def test_markup_may_nest_deeply(tag):
    page = f"<{tag}>" * 2500 + "deep" + '<div id="divRplyFwdMsg">q</div>'
    assert "deep" in html.markdown(page) and "deep" in html.sanitize(page)
    html.segment(page)
    html.filter_images(page, signatures=True, pixels=True)
    html.quote_patterns(html.sanitize(page))


def test_warnings_zones_and_retained_names(spark, monkeypatch):
    rows = [("h", b"Subject: s\nContent-Type: text/html\n\n<p>new</p><blockquote>old</blockquote>"), ("g", b'Subject: s\nContent-Type: text/html\n\n<p>new</p><div class="gmail_quote">old</div>'), ("d", b"Content-Type: multipart/mixed\n\nno parts")]
    part = lambda n, c: f"--b\nContent-Type: image/png; name={n}\nContent-ID: <{c}>\nContent-Transfer-Encoding: base64\n\nQQ==\n"
    rows.append(("i", ("Subject: s\nContent-Type: multipart/related; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>x <img src='cid:one'></p>\n" + part("p.png", "one") + part("p.png", "two") + part("q.png", "three") + "--b--\n").encode()))
    done = {r.source: r for r in convert.convert_df(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary"), ConvertOptions(strip_tracking_pixels=True)).collect()}
    assert all(r.success for r in done.values()), [r.error for r in done.values()]
    assert {z.kind: z.metadata for z in done["h"].zones}["BODY"] == {"quote_patterns": "generic"}
    assert {z.metadata.get("client_hint") for z in done["g"].zones} == {"gmail"}
    assert done["d"].diagnostics.warnings and {(w.code, w.severity) for w in done["d"].diagnostics.warnings} == {("mime_defect", "warning")} and all(w.message for w in done["d"].diagnostics.warnings)
    assert done["i"].attachments == ["p.png"] and [p.content_id for p in done["i"].attachment_parts] == ["one"]


def test_lifecycle_is_sticky(spark):
    from postmill.operators import reports

    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "failed"), (1, 4, "running"), (2, 1, "running"), (2, 5, "queued"), (2, 6, "cancelled")], "job int, at int, status string")
    got = {r.job: tuple(r)[1:] for r in reports.lifecycle(log, job="job", at=["at"], status="status").select("job", "status", F.col("started_at").cast("int"), F.col("finished_at").cast("int")).collect()}
    assert got == {1: ("failed", 2, 3), 2: ("cancelled", None, 6)}
