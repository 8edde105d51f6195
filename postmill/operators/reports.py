"""Reports over results, and job status, history and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Job states, and which may follow which.
TERMINAL = ("succeeded", "completed_with_errors", "failed", "cancelled")
TRANSITIONS = {"queued": ("running", "cancelled"), "running": TERMINAL}
KEPT_JOBS, HISTORY_LIMIT, MOST_HISTORY = 2000, 50, 200


def counters(success: Column, output: Column) -> dict[str, Column]:
    """Aggregates over result rows: total, written, skipped, errors."""
    return {"total": F.count("*"), "written": F.count_if(success & output.isNotNull()), "skipped": F.count_if(success & output.isNull()), "errors": F.count_if(~success)}


def report_status(ok: Column, errors: Column) -> Column:
    """State of a finished report: no files at all is a success."""
    return F.when((errors > 0) & (ok > 0), "completed_with_errors").when(errors > 0, "failed").otherwise("succeeded")


def job_status(cancelled: Column, mode: Column, errors: Column) -> Column:
    return F.when(cancelled, "cancelled").when((mode == "file") & (errors > 0), "failed").when(errors > 0, "completed_with_errors").otherwise("succeeded")


def safe_text(c: Column) -> Column:
    """Without NUL characters and invalid sequences."""
    return F.make_valid_utf8(F.replace(c, F.lit("\0"), F.lit("")))


def transitions(log: DataFrame, *, job: str, at: list[str], status: str) -> DataFrame:
    """`log` with the state before each entry and whether the step is allowed; a first entry must be `queued`."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*at))
    allowed = before.isNull() & (F.col(status) == "queued")
    for old, new in TRANSITIONS.items():
        allowed = allowed | ((before == old) & F.col(status).isin(*new))
    return log.withColumn("before", before).withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def lifecycle(log: DataFrame, *, job: str, at: list[str], status: str) -> DataFrame:
    """(job, status, started_at, finished_at) of each job from its log of states, in order of `at`.

    Only allowed steps count, each judged against the last one that counted: a
    job that has ended stays as it ended. A job starts when it first runs.
    """
    entry = F.struct(*at, F.col(status).alias("status"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast(log.schema[at[0]].dataType).alias("started_at"), F.lit(None).cast(log.schema[at[0]].dataType).alias("finished_at"))

    def step(s: Column, e: Column) -> Column:
        new = e["status"]
        allowed = s["status"].isNull() & (new == "queued")
        for old, next_ in TRANSITIONS.items():
            allowed = allowed | (s["status"].eqNullSafe(F.lit(old)) & new.isin(*next_))
        then = F.struct(new.alias("status"), F.when(new == "running", F.coalesce(s["started_at"], e[at[0]])).otherwise(s["started_at"]).alias("started_at"), F.when(new.isin(*TERMINAL), e[at[0]]).alias("finished_at"))
        return F.when(allowed, then).otherwise(s)

    folded = log.groupBy(job).agg(F.array_sort(F.collect_list(entry)).alias("log"))  # the log of one job
    return folded.select(job, F.aggregate("log", start, step).alias("s")).select(job, "s.*")


def worker_counters(success: Column, dry_run: Column) -> dict[str, Column]:
    """Aggregates over the files of a job: completed, failed, written, skipped (done, but only as a dry run) and errors."""
    good = F.count_if(success)
    return {"completed": good, "failed": F.count_if(~success), "written": F.count_if(success & ~dry_run), "skipped": F.count_if(success & dry_run), "errors": F.count_if(~success)}


def history_totals(jobs: DataFrame, *, status: str = "status") -> DataFrame:
    """(jobs, failed, succeeded) over all terminal jobs, however many the history shows."""
    done = jobs.filter(F.col(status).isin(*TERMINAL))
    return done.agg(F.count("*").alias("jobs"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_if(F.col(status) == "succeeded").alias("succeeded"))


def _newest(finished: str, created: str, job: str) -> list[Column]:
    return [F.coalesce(F.col(finished), F.col(created)).desc(), F.col(created).desc(), F.col(job).desc()]


def history(jobs: DataFrame, *, limit: int = HISTORY_LIMIT, status: str = "status", finished: str = "finished_at", created: str = "created_at", job: str = "id") -> DataFrame:
    """The newest terminal jobs, `limit` of them (1 to 200)."""
    return jobs.filter(F.col(status).isin(*TERMINAL)).orderBy(*_newest(finished, created, job)).limit(max(1, min(limit, MOST_HISTORY)))


def surplus(jobs: DataFrame, *, keep: int = KEPT_JOBS, status: str = "status", finished: str = "finished_at", created: str = "created_at", job: str = "id") -> DataFrame:
    """The terminal jobs that are older than the newest `keep`, found from the last of these, not by numbering all."""
    done = jobs.filter(F.col(status).isin(*TERMINAL))
    key = F.struct(F.coalesce(F.col(finished), F.col(created)).alias("f"), F.col(created).alias("c"), F.col(job).alias("j"))
    last = done.select(key.alias("k")).orderBy(F.desc("k")).limit(keep).agg(F.min("k").alias("k"), F.count("*").alias("n"))
    edge = last.filter(F.col("n") == keep).select("k").scalar()
    return done.filter(key < edge)


def recovery_action(code: Column, mode: Column, repair_available: Column, repair_on: Column, fallback_available: Column, fallback_on: Column) -> Column:
    """What may be tried again after a failure of a single file: repair first, then plain text."""
    eligible = (mode == "file") & code.eqNullSafe("html_markdown_failed")
    return F.when(eligible & repair_available & ~repair_on, "retry_with_html_repair").when(eligible & fallback_available & ~fallback_on, "retry_with_html_fallback")
