"""Writers of Markdown documents, bundles and report files.

Final names are computed in the plan, beside the names that are there already.
Files are written aside and linked into place, which never replaces a file; a
task that runs twice finds its own file and leaves it. Sources are moved or
deleted on the driver, each after its own result is there; if that fails, the
result is taken back.
"""

from __future__ import annotations

import filecmp
import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import asdict
from datetime import UTC, datetime
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.names import MOST_SUFFIXES, numbered
from postmill.operators.convert import convert_df, document
from postmill.operators.reports import counters, report_status
from postmill.options import ConvertOptions
from postmill.sources.eml import path_order, scan_local, validated


def _aside(path: str, data: bytes) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, aside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".postmill-")
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    return aside


def write_whole(path: str, data: bytes) -> None:
    """Write a file so that it is there whole or not at all, in place of one of its name."""
    os.replace(_aside(path, data), path)


def candidates(path: str) -> Iterator[str]:
    """The names under which a file may be written: its own, then -2, -3 and so on before the suffix; raises after MOST_SUFFIXES."""
    stem, suffix = os.path.splitext(path)
    yield path
    for k in range(2, MOST_SUFFIXES + 1):
        yield f"{stem}-{k}{suffix}"
    raise RuntimeError(f"no free name for {path}")


def write_new(path: str, data: bytes, *, again: bool = False) -> str:
    """Write a file under the first name that is free, and return it; no file is ever replaced.

    With `again`, a file of the first name with just these bytes is taken for
    one's own from an attempt before.
    """
    aside = _aside(path, data)
    try:
        for target in candidates(path):
            try:
                os.link(aside, target)
                return target
            except FileExistsError:
                if again and target == path and os.path.isfile(path) and filecmp.cmp(aside, path, shallow=False):
                    return path
    finally:
        os.unlink(aside)
    raise AssertionError


def new_folder(path: str) -> str:
    """Make a folder under the first name that is free."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for target in candidates(path):
        try:
            os.mkdir(target)
            return target
        except FileExistsError:
            continue
    raise AssertionError


def taken_names(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """(_folder, slug) of the documents that are in these folders (a column _folder) already; each folder is listed in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, n[:-3]) for d in batch.column(0).to_pylist() if os.path.isdir(d) for n in os.listdir(d) if n.endswith(".md")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["_folder", "slug"])

    return folders.select("_folder").distinct().mapInArrow(run, "_folder string, slug string")


def planned_outputs(results: DataFrame, root: str, output: str | None) -> DataFrame:
    """`results` with `output`: below the output folder, in the source's relative folder, named by slug, numbered where names clash.

    Only rows that succeeded take names, in path order, beside those on disk.
    If no name is free the row has failed. Names are found from a few columns.
    """
    source = F.regexp_replace("source", r"^file:(//)?(?=/)", "")
    folder = F.regexp_replace(F.col("source"), r"/[^/]*$", "")
    base = folder if output is None else F.concat(F.lit(output.rstrip("/")), F.substr(folder, F.lit(len(root.rstrip("/")) + 1)))
    placed = results.withColumn("source", source)
    narrow = placed.filter("success").select("source", base.alias("_folder"), "slug", path_order(F.col("source")).alias("_at"))
    named = numbered(narrow, folder="_folder", name="slug", order="_at", existing=taken_names(results.sparkSession, narrow))
    targets = named.select(F.col("source").alias("_source"), F.concat("_folder", F.lit("/"), "final_name", F.lit(".md")).alias("output"))
    joined = placed.join(targets, F.col("source") == F.col("_source"), "left").drop("_source")
    full = F.col("success") & F.col("output").isNull()
    return joined.withColumns({"error": F.when(full, F.lit("no free name")).otherwise(F.col("error")), "success": F.col("success") & ~full})


def write_documents(results: DataFrame) -> DataFrame:
    """Write the document of each successful row to its `output`; (source, output, written, write_error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                error = None
                if row["success"]:
                    try:
                        row["output"] = write_new(row["output"], document(row).encode("utf-8", "surrogatepass"), again=True)
                    except (OSError, RuntimeError) as e:
                        error = str(e)
                out.append((row["source"], row["output"], bool(row["success"]) and error is None, error))
            kinds = (("source", pa.string()), ("output", pa.string()), ("written", pa.bool_()), ("write_error", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    needed = results.select("source", "output", "success", "subject", "sender", "date", "attachments", "calendar", F.col("headers").alias("headers"), "raw_html", "body")
    return needed.mapInArrow(run, "source string, output string, written boolean, write_error string")


def _settle(row: dict, options: ConvertOptions) -> None:
    """Delete the source of a written row if that is asked for; if it cannot be, take the document back."""
    if not (row["success"] and row["output"] and options.delete_eml):
        return
    try:
        os.unlink(row["source"])
    except OSError as e:
        os.unlink(row["output"])
        row |= {"success": False, "error": str(e), "output": None}


def convert_dir(spark: SparkSession, directory: str, *, output: str | None = None, options: ConvertOptions | None = None) -> list[dict]:
    """Convert all messages below a folder; a result for each, in path order. Raises if there is no such folder."""
    options = options or ConvertOptions()
    root = os.path.realpath(os.path.expanduser(directory))
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise ValueError(f"not a folder: {root}")
    light = ("source", "slug", "subject", "sender", "date", "attachments", "calendar", "headers", "raw_html", "body", "success", "error", "error_code", "plain_text_fallback_available", "html_repair_available", "diagnostics")
    converted = convert_df(scan_local(spark, root), options).select(*light).persist()  # without the bytes of attachments
    try:
        rows = planned_outputs(converted, root, output and os.path.realpath(os.path.expanduser(output)))
        done = {} if options.dry_run else {r["source"]: r for r in write_documents(rows).collect()}
        shown = rows.drop("slug", "calendar", "headers", "raw_html", "body", "output")
        found = [r.asDict(recursive=True) for r in shown.collect()]  # a row per file that the driver has listed
    finally:
        converted.unpersist()
    for r in found:
        r |= {"dry_run": options.dry_run, "output": None}
        if r["success"] and not options.dry_run:
            written = done[r["source"]]
            r |= {"output": written["output"]} if written["written"] else {"success": False, "error": written["write_error"]}
            _settle(r, options)
    return sorted(found, key=lambda r: r["source"].split(os.sep))


def _converted(spark: SparkSession, source: str, options: ConvertOptions) -> dict:
    """The result row of one file on the driver's disk."""
    with open(source, "rb") as f:
        message = spark.createDataFrame([(source, f.read())], "path string, content binary")
    return convert_df(message, options).first().asDict(recursive=True)


def convert(spark: SparkSession, path: str, *, output: str | None = None, options: ConvertOptions | None = None) -> dict:
    """Convert one message file. `output` may be a .md file or a folder; what is there is never replaced."""
    options = options or ConvertOptions()
    source = validated(path)
    row = _converted(spark, source, options) | {"source": source, "output": None, "dry_run": options.dry_run}
    if row["success"] and not options.dry_run:
        exact = output is not None and output.lower().endswith(".md")
        target = os.path.expanduser(output) if exact else os.path.join(os.path.expanduser(output) if output else os.path.dirname(source), f"{row['slug']}.md")
        try:
            row["output"] = write_new(target, document(row).encode("utf-8", "surrogatepass"))
        except (OSError, RuntimeError) as e:
            row |= {"success": False, "error": str(e)}
        _settle(row, options)
    return row


def convert_to_bundle(spark: SparkSession, path: str, *, bundle_root: str, options: ConvertOptions | None = None, source_handling: str = "move") -> dict:
    """A folder named by the file, with message.md, attachments and the source (moved, copied or deleted)."""
    options = options or ConvertOptions()
    source = validated(path)
    row = _converted(spark, source, options)
    stem = os.path.splitext(os.path.basename(source))[0] or "message"
    out = {k: row[k] for k in ("success", "error", "error_code", "diagnostics", "plain_text_fallback_available", "html_repair_available")} | {"source": source, "bundle": None, "markdown": None, "source_artifact": None, "attachments": [], "dry_run": options.dry_run}
    if not row["success"]:
        return out
    if options.dry_run:
        return out | {"bundle": next(p for p in candidates(os.path.join(bundle_root, stem)) if not os.path.exists(p))}
    bundle = None
    try:
        bundle = new_folder(os.path.join(bundle_root, stem))
        names = [os.path.basename(write_new(os.path.join(bundle, "attachments", part["filename"]), bytes(part["payload"]))) for part in row["attachment_parts"] or []]
        out["attachments"] = [os.path.join("attachments", n) for n in names]
        write_whole(os.path.join(bundle, "message.md"), document(row | {"attachment_files": out["attachments"]}).encode("utf-8", "surrogatepass"))
        if source_handling == "delete":
            os.unlink(source)
        else:
            out["source_artifact"] = (shutil.move if source_handling == "move" else shutil.copy2)(source, os.path.join(bundle, os.path.basename(source)))
        out |= {"bundle": bundle, "markdown": os.path.join(bundle, "message.md")}
    except (OSError, RuntimeError) as e:
        if bundle is not None:
            shutil.rmtree(bundle, ignore_errors=True)
        out |= {"success": False, "error": str(e), "attachments": [], "source_artifact": None}
    return out


def report_folder(input_path: str, output: str | None) -> str:
    """Where a report goes: beside the output, or to the input folder or the one of the input file."""
    if output is None:
        return input_path if os.path.isdir(input_path) else os.path.dirname(input_path) or "."
    return os.path.dirname(output) or "." if output.lower().endswith(".md") else output


def _below(path: str, folder: str) -> str | None:
    """The path relative to a folder that holds it, or None."""
    real, top = os.path.realpath(path), os.path.realpath(folder)
    return os.path.relpath(real, top).replace(os.sep, "/") if os.path.commonpath([real, top]) == top else None


def report_source(source: str, *, input_path: str, mode: str) -> str:
    """In a report a source is relative to the input folder, or the name of the file."""
    inside = _below(source, input_path) if mode == "directory" else None
    return inside if inside is not None else os.path.basename(source)


def report_output(output: str | None, *, folder: str) -> str | None:
    """In a report an output is relative to the report's folder if it lies in it."""
    inside = None if output is None else _below(output, folder)
    return inside if inside is not None else output


def bundle_error(result: dict) -> dict | None:
    """The error item of a failed bundle; none if it succeeded."""
    if result["success"]:
        return None
    return {"path": result["source"], "code": "conversion_error", "message": result["error"] or "conversion failed", "stage": "core"}


def directory_summary(results: list[dict]) -> dict:
    """Counts, outputs and errors of a converted folder."""
    good, bad = ([r for r in results if r["success"] is wanted] for wanted in (True, False))
    return {"total": len(results), "successes": len(good), "failures": len(bad), "output_paths": [r["output"] for r in good if r["output"]], "errors": [{"file": r["source"], "error": r["error"]} for r in bad]}


def cleaned(value):
    """A value of a report, keys included, without NUL characters, lone surrogates replaced."""
    if isinstance(value, str):
        return value.replace("\0", "").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        return {cleaned(k): cleaned(v) for k, v in value.items()}
    return [cleaned(v) for v in value] if isinstance(value, list | tuple) else value


def build_report(spark: SparkSession, results: list[dict], options: ConvertOptions, *, input_path: str, input_mode: str, duration_ms: int, folder: str | None = None, job: str | None = None, status: str | None = None) -> dict:
    """The report of a run, its counters aggregated from the result rows; paths are relative to the input and to `folder`."""
    rows = spark.createDataFrame([(r["output"], bool(r["success"])) for r in results], "output string, success boolean")
    n = rows.agg(*(c.alias(k) for k, c in counters(F.col("success"), F.col("output")).items())).withColumn("status", report_status(F.col("written") + F.col("skipped"), F.col("errors"))).first()
    at = folder or report_folder(input_path, None)

    def entry(r: dict) -> dict:
        found = {"source": report_source(r["source"], input_path=input_path, mode=input_mode), "output": report_output(r["output"], folder=at), "success": r["success"]}
        if r["success"]:
            return found | ({"diagnostics": r["diagnostics"]} if r["diagnostics"] else {})
        return found | {"error": {"code": r["error_code"], "message": r["error"]}}

    report = {
        "schema_version": 1, "generator": {"name": "postmill"}, "created_at": datetime.now(UTC).isoformat(),
        "job": {"id": job or uuid4().hex, "status": status or n["status"], "duration_ms": duration_ms, "input_path": input_path, "input_mode": input_mode},
        "options": {k: v for k, v in asdict(options).items() if k != "report"}, "summary": {k: n[k] for k in ("total", "written", "skipped", "errors")}, "results": [entry(r) for r in results],
    }
    return cleaned(report)


def write_report(report: dict, folder: str, name: str) -> str:
    """Write a report in a folder. `name` must be a bare name; NUL and lone surrogates are replaced throughout."""
    if os.path.basename(name) != name or not name:
        raise ValueError(f"not a file name: {name}")
    path = os.path.join(folder, name)
    write_whole(path, (json.dumps(cleaned(report), indent=2, ensure_ascii=False, default=str) + "\n").encode())
    return path
