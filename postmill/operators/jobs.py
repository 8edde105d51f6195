"""Job bookkeeping outside of data frames: landing folders, settings, retries, failures and cleanup."""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import BinaryIO
from uuid import uuid4

from pyspark.sql import SparkSession

from postmill.operators.reports import TERMINAL, TRANSITIONS
from postmill.operators.sinks import build_report, bundle_error, convert_to_bundle, write_report, write_whole
from postmill.options import ConvertOptions
from postmill.sources.eml import job_files

CHUNK_BYTES, MOST_NAMES = 1 << 20, 10_000


def land(stream: BinaryIO, inbox: str, name: str, *, batch: str | None = None) -> str:
    """Copy an upload into the inbox, or a batch folder in it, under a name of its own; nothing is left of a failed copy."""
    folder = os.path.join(inbox, f"_batch-{batch}") if batch else inbox
    os.makedirs(folder, exist_ok=True)
    stem = os.path.splitext(os.path.basename(name.replace("\\", "/")))[0] or "message"
    for k in range(1, MOST_NAMES + 1):
        path = os.path.join(folder, f"{stem}{'' if k == 1 else f'-{k}'}.eml")
        try:
            out = open(path, "xb")
        except FileExistsError:
            continue
        try:
            with out:
                shutil.copyfileobj(stream, out, CHUNK_BYTES)
        except BaseException:
            os.unlink(path)
            raise
        return path
    raise RuntimeError(f"no free name for {name}")


def leave(folder: str) -> bool:
    """Remove a batch folder if it is empty."""
    if not os.path.basename(folder.rstrip("/")).startswith("_batch-") or os.listdir(folder):
        return False
    os.rmdir(folder)
    return True


def checked_paths(inbox: str, cabinet: str) -> tuple[str, str]:
    """The real paths of two folders of which neither lies in the other."""
    a, b = os.path.realpath(inbox), os.path.realpath(cabinet)
    if os.path.commonpath([a, b]) in (a, b):
        raise ValueError("inbox and cabinet must be separate folders")
    return a, b


def load_settings(path: str) -> dict[str, str] | None:
    """The settings in a file, or None if there is none that can be used."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        inbox, cabinet = checked_paths(found["inbox_path"], found["cabinet_path"])
    except (OSError, ValueError, KeyError, TypeError):
        return None
    if any(os.path.exists(p) and not os.path.isdir(p) for p in (inbox, cabinet)):
        return None
    return {"inbox_path": inbox, "cabinet_path": cabinet}


def save_settings(path: str, inbox: str, cabinet: str) -> dict[str, str]:
    """Check the two folders, make them if they are not there, and write them to a file."""
    a, b = checked_paths(os.path.expanduser(inbox), os.path.expanduser(cabinet))
    for folder in (a, b, os.path.dirname(os.path.abspath(path))):
        os.makedirs(folder, exist_ok=True)
    found = {"inbox_path": a, "cabinet_path": b}
    write_whole(path, (json.dumps(found, indent=2, sort_keys=True) + "\n").encode())
    return found


def retried(options: ConvertOptions, action: str, offered: str | None) -> ConvertOptions:
    """The options of a second try; only the action that was offered is allowed."""
    changes = {"retry_with_html_repair": "allow_html_repair_on_panic", "retry_with_html_fallback": "allow_fallback_on_html_error"}
    if action not in changes:
        raise ValueError(f"unknown action: {action}")
    if action != offered:
        raise RuntimeError("this action is not offered")
    return replace(options, **{changes[action]: True})


def failures(error: BaseException) -> list[dict[str, str]]:
    """One item for each error in a group of errors."""
    inner: Iterable[BaseException] = error.exceptions if isinstance(error, BaseExceptionGroup) else ()
    return [x for e in inner for x in failures(e)] or [{"code": "job_failed", "message": str(error) or type(error).__name__, "stage": "job"}]


@dataclass
class Job:
    """A job and its counters."""

    mode: str
    input_path: str
    options: ConvertOptions
    origin: str = "form"
    id: str = field(default_factory=lambda: uuid4().hex)
    status: str = "queued"
    created_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    started_at: datetime | None = None
    finished_at: datetime | None = None
    cancel_requested: bool = False
    total: int = 0
    completed: int = 0
    failed: int = 0
    written: int = 0
    skipped: int = 0
    errors: list[dict] = field(default_factory=list)
    results: list[dict] = field(default_factory=list)
    report_path: str | None = None

    def move(self, status: str) -> None:
        """To another state, if that may follow; a job starts once and ends once."""
        if status not in TRANSITIONS.get(self.status, ()):
            raise ValueError(f"{self.status} cannot become {status}")
        self.status = status
        if status == "running" and self.started_at is None:
            self.started_at = datetime.now(UTC)
        if status in TERMINAL:
            self.finished_at = datetime.now(UTC)

    def outcome(self) -> str:
        if self.cancel_requested:
            return "cancelled"
        if not self.errors:
            return "succeeded"
        return "failed" if self.mode == "file" else "completed_with_errors"


class JobRunner:
    """Runs jobs of messages into bundles of a cabinet, some at a time; all state is on the driver, the work in Spark."""

    def __init__(self, spark: SparkSession, cabinet: str, *, workers: int = 8) -> None:
        self.spark, self.cabinet = spark, os.path.realpath(cabinet)
        self.jobs: dict[str, Job] = {}
        self._done: dict[str, threading.Event] = {}
        self._lock = threading.RLock()
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="postmill-job")

    def submit(self, mode: str, input_path: str, options: ConvertOptions | None = None, *, origin: str = "form") -> Job:
        """Start a job; raises if its input is not allowed."""
        files = job_files(mode, input_path, self.cabinet)
        job = Job(mode, os.path.realpath(os.path.expanduser(input_path)), options or ConvertOptions(), origin, total=len(files))
        with self._lock:
            self.jobs[job.id], self._done[job.id] = job, threading.Event()
        self._pool.submit(self._run, job, files)
        return job

    def _run(self, job: Job, files: list[str]) -> None:
        try:
            with self._lock:
                if job.status != "queued":
                    return
                job.move("running")
            self.spark.addTag(f"postmill-{job.id}")
            for path in files:
                if job.cancel_requested:
                    break
                self._take(job, convert_to_bundle(self.spark, path, bundle_root=self.cabinet, options=job.options))
        except Exception as e:
            if not job.cancel_requested:
                with self._lock:
                    job.errors += failures(e)
                    job.failed += len(failures(e))
        finally:
            with self._lock:
                if job.status == "running":
                    job.move(job.outcome())
            self._report(job)
            if os.path.isdir(job.input_path):
                leave(job.input_path)
            self._done[job.id].set()

    def _take(self, job: Job, result: dict) -> None:
        with self._lock:
            job.results.append(result | {"output": result["bundle"] if not job.options.dry_run else None})
            if error := bundle_error(result):
                job.failed += 1
                job.errors.append(error)
            else:
                job.completed += 1
                job.skipped += job.options.dry_run
                job.written += not job.options.dry_run

    def _report(self, job: Job) -> None:
        """A report of its own for each job that asks for one, whatever its outcome, with no files too."""
        if not job.options.report:
            return
        spent = round(1000 * ((job.finished_at or datetime.now(UTC)) - (job.started_at or job.created_at)).total_seconds())
        os.makedirs(self.cabinet, exist_ok=True)
        report = build_report(self.spark, job.results, job.options, input_path=job.input_path, input_mode=job.mode, duration_ms=spent, folder=self.cabinet, job=job.id, status=job.status)
        job.report_path = write_report(report, self.cabinet, f".postmill-report-{job.id}.json")

    def cancel(self, id: str) -> bool | None:
        """Ask a job to stop; whether that was accepted, None if there is no such job. A job that waits ends at once, one that runs after its file."""
        with self._lock:
            job = self.jobs.get(id)
            if job is None:
                return None
            if job.status in TERMINAL:
                return False
            job.cancel_requested = True
            if job.status == "queued":
                job.move("cancelled")
        self.spark.interruptTag(f"postmill-{id}")
        return True

    def wait(self, id: str, seconds: float | None = None) -> Job:
        """The job once it has ended; raises TimeoutError if it does not in time."""
        until = None if seconds is None else time.monotonic() + seconds
        if not self._done[id].wait(seconds) or (until is not None and time.monotonic() > until and self.jobs[id].status not in TERMINAL):
            raise TimeoutError(id)
        return self.jobs[id]

    def retry(self, id: str, action: str, offered: str | None) -> Job:
        """A new job with the options of a second try."""
        job = self.jobs[id]
        if job.status not in TERMINAL:
            raise RuntimeError("the job has not ended")
        return self.submit(job.mode, job.input_path, retried(job.options, action, offered), origin=job.origin)

    def close(self) -> None:
        self._pool.shutdown(wait=True)
