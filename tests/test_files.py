"""Scans, writers, bundles, reports and the watcher on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postmill.functions import registry
from postmill.operators import jobs, sinks
from postmill.options import ConvertOptions
from postmill.sources import eml, listing
from postmill.streaming import watch

MAIL = "From: A <a@b.c>\r\nSubject: {}\r\n\r\n{}\r\n"


def _mail(folder, name, subject, body="hello"):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(MAIL.format(subject, body))


@pytest.fixture
def inbox(tmp_path):
    root = str(tmp_path / "in")
    for name, subject in (("a.eml", "Same"), ("b.EML", "Re: same"), ("d/c.eml", "Other"), ("_batch-1/e.eml", "Hidden"), ("note.txt", "No")):
        _mail(root, name, subject)
    return root


def test_scans_and_listing(spark, inbox, tmp_path):
    assert [os.path.relpath(p, inbox) for p in eml.local_messages(inbox)] == ["_batch-1/e.eml", "a.eml", "b.EML", "d/c.eml"]
    _mail(str(tmp_path / "elsewhere"), "foreign.eml", "Foreign")
    os.symlink(tmp_path / "elsewhere", os.path.join(inbox, "out"))
    os.symlink(tmp_path / "elsewhere" / "foreign.eml", os.path.join(inbox, "link.eml"))
    assert eml.scan(spark, inbox).count() == eml.scan_local(spark, inbox).count() == 4
    assert not eml.scan(spark, inbox).filter("path like '%foreign%' or path like '%link%'").count()
    with pytest.raises(PermissionError):
        listing.list_dir(spark, inbox, "out")
    assert [os.path.relpath(p, inbox) for p in eml.backlog(inbox)] == ["a.eml", "b.EML", "d/c.eml"]
    assert eml.scan_local(spark, str(tmp_path / "none")).count() == 0
    assert [r.name for r in listing.list_dir(spark, inbox, suffix=".eml").collect() if r.name not in ("out", "link.eml")] == ["_batch-1", "d", "a.eml", "b.EML"]
    with pytest.raises(PermissionError):
        listing.normalized("../x")
    with pytest.raises(ValueError):
        eml.validated(os.path.join(inbox, "note.txt"))


def test_convert_dir_names_and_report(spark, inbox, tmp_path):
    out = str(tmp_path / "out")
    dry = sinks.convert_dir(spark, inbox, output=out, options=ConvertOptions(dry_run=True))
    assert [r["success"] for r in dry] == [True] * 4 and not os.path.exists(out)
    done = sinks.convert_dir(spark, inbox, output=out)
    assert [os.path.relpath(r["output"], out) for r in done] == ["_batch-1/hidden.md", "same.md", "same-2.md", "d/other.md"]
    assert open(os.path.join(out, "same.md")).read().endswith("---\n\nhello\n")
    report = sinks.build_report(spark, done, ConvertOptions(), input_path=inbox, input_mode="directory", duration_ms=1)
    assert report["summary"] == {"total": 4, "written": 4, "skipped": 0, "errors": 0} and report["job"]["status"] == "succeeded"
    assert json.load(open(sinks.write_report(report, out, "r.json")))["results"][0]["diagnostics"]["state"] == "normal"
    assert os.path.exists(os.path.join(out, "r.json"))


def test_single_and_bundle(spark, inbox, tmp_path):
    source = os.path.join(inbox, "a.eml")
    assert [os.path.basename(sinks.convert(spark, source, output=str(tmp_path))["output"]) for _ in range(2)] == ["same.md", "same-2.md"]
    made = sinks.convert_to_bundle(spark, source, bundle_root=str(tmp_path / "cab"), source_handling="copy")
    assert made["success"] and os.path.exists(os.path.join(made["bundle"], "message.md")) and os.path.exists(source)
    moved = sinks.convert_to_bundle(spark, source, bundle_root=str(tmp_path / "cab"))
    assert moved["bundle"].endswith("a-2") and not os.path.exists(source)


def test_watch_converts_backlog(spark, inbox, tmp_path):
    got = []
    q = watch.watch(spark, inbox, lambda df, n: got.extend(r.subject for r in df.select("subject").collect()), checkpoint=str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60) in (True, None)
    assert sorted(got) == ["Other", "Re: same", "Same"]


def test_watch_waits_for_a_file_that_is_being_copied(spark, tmp_path):
    import threading
    import time

    root, got = str(tmp_path / "in"), []
    _mail(root, "odd [1] é.eml", "Odd")
    open(os.path.join(root, "slow [1] é.eml"), "w").close()

    def copy():
        with open(os.path.join(root, "slow [1] é.eml"), "a") as f:
            time.sleep(0.2)
            f.write(MAIL.format("Slow", "begin"))
            for k in range(100):
                f.write(f"part {k}\n")
                f.flush()
                time.sleep(0.1)

    copying = threading.Thread(target=copy)
    copying.start()
    q = watch.watch(spark, root, lambda df, n: got.extend(df.select("subject", "body").collect()), checkpoint=str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(90) in (True, None)
    copying.join()
    found = {r.subject: r.body for r in got}
    assert sorted(found) == ["Odd", "Slow"] and len(got) == 2 and found["Odd"] == "hello" and "part 99" in found["Slow"]


def test_settled_leaves_out_missing_files(spark, inbox):
    a = os.path.join(inbox, "a.eml")
    assert watch.settled(spark, [f"file:{a}", f"file:{inbox}/gone.eml"]) == [f"file:{a}"]


def test_dedupe_is_a_fold(spark):
    rows = [(1, t, k) for k, t in enumerate([0, 3, 6, 11, 11, 20])]
    df = spark.createDataFrame(rows, "k int, at long, id int")
    assert [r.fresh for r in watch.dedupe(df, key=["k"], at="at", order="id").orderBy("id").collect()] == [True, False, True, True, False, True]
    times = spark.range(1).select(watch.accepted(F.array(*map(F.lit, (0, 3, 6, 11))), F.lit(5)).alias("t")).first().t
    assert times == [0, 6, 11]


def test_dedupe_stream_keeps_state_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "events"), []
    make = lambda rows: spark.createDataFrame(rows, "path string, at double").coalesce(1).write.mode("append").parquet(source)
    make([("a", 0.0), ("a", 3.0), ("b", 1.0)])
    stream = watch.dedupe_stream(spark.readStream.schema("path string, at double").parquet(source))
    start = lambda: stream.writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    start()
    make([("a", 4.0), ("a", 6.0), ("b", 5.0)])
    start()
    assert sorted(out) == [("a", 0.0, True), ("a", 3.0, False), ("a", 4.0, False), ("a", 6.0, True), ("b", 1.0, True), ("b", 5.0, False)]


def test_jobs_and_registry(spark, tmp_path):
    import io

    first = jobs.land(io.BytesIO(b"x"), str(tmp_path), "../m.eml", batch="1")
    second = jobs.land(io.BytesIO(b"y"), str(tmp_path), "m.eml", batch="1")
    assert first.endswith("_batch-1/m.eml") and second.endswith("_batch-1/m-2.eml") and not jobs.leave(os.path.dirname(first))
    os.unlink(first), os.unlink(second)
    assert jobs.leave(os.path.dirname(first)) and not os.path.exists(os.path.dirname(first))
    with pytest.raises(ValueError):
        jobs.checked_paths(str(tmp_path), str(tmp_path / "in"))
    assert jobs.load_settings(str(tmp_path / "none")) is None
    assert jobs.retried(ConvertOptions(), "retry_with_html_repair", "retry_with_html_repair").allow_html_repair_on_panic
    with pytest.raises(RuntimeError):
        jobs.retried(ConvertOptions(), "retry_with_html_repair", None)
    assert len(jobs.failures(ExceptionGroup("g", [ValueError("a"), ExceptionGroup("h", [OSError("b")])]))) == 2
    registry.register(spark)
    row = spark.sql("SELECT slugify('Re: A b'), html_to_markdown('<b>x</b>'), reply_zones('hi')[0].kind, parse_eml(cast('Subject: s\\n\\nb' as binary)).subject").first()
    assert tuple(row) == ("a-b", "**x**", "BODY", "s")
