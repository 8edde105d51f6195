"""The functions of the package: files in, files out, with typed results. They use the active Spark session, or start one."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from postmill.operators import sinks
from postmill.options import ConvertOptions


@dataclass(frozen=True)
class ConvertResult:
    """What became of one message."""

    source: Path
    output: Path | None
    subject: str
    sender: str
    date: str | None
    success: bool
    attachments: list[str] = field(default_factory=list)
    error: str | None = None
    error_code: str | None = None
    plain_text_fallback_available: bool | None = None
    html_repair_available: bool | None = None
    diagnostics: dict[str, Any] | None = None
    dry_run: bool = False


@dataclass(frozen=True)
class BundleResult:
    """What became of one message that was made into a folder."""

    source: Path
    bundle: Path | None
    markdown: Path | None
    source_artifact: Path | None
    success: bool
    attachments: list[Path] = field(default_factory=list)
    error: str | None = None
    error_code: str | None = None
    plain_text_fallback_available: bool | None = None
    html_repair_available: bool | None = None
    diagnostics: dict[str, Any] | None = None
    dry_run: bool = False


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _result(row: dict) -> ConvertResult:
    given = {k: row[k] for k in ConvertResult.__dataclass_fields__}
    return ConvertResult(**given | {"source": Path(row["source"]), "output": row["output"] and Path(row["output"]), "attachments": list(row["attachments"] or [])})


def convert(path: str | Path, *, output: str | Path | None = None, options: ConvertOptions | None = None) -> ConvertResult:
    """Convert one .eml file; a file that is missing or no .eml file raises, what else goes wrong is in the result."""
    return _result(sinks.convert(session(), str(path), output=None if output is None else str(output), options=options))


def convert_dir(directory: str | Path, *, output: str | Path | None = None, options: ConvertOptions | None = None) -> list[ConvertResult]:
    """Convert all .eml files below a folder, a result for each in path order."""
    return [_result(r) for r in sinks.convert_dir(session(), str(directory), output=None if output is None else str(output), options=options)]


def convert_to_bundle(path: str | Path, *, bundle_root: str | Path, options: ConvertOptions | None = None, source_handling: str = "move") -> BundleResult:
    """Convert one .eml file into a folder with message.md, attachments and the source."""
    row = sinks.convert_to_bundle(session(), str(path), bundle_root=str(bundle_root), options=options, source_handling=source_handling)
    there = lambda k: row[k] and Path(row[k])
    given = {k: row[k] for k in BundleResult.__dataclass_fields__}
    return BundleResult(**given | {"source": Path(row["source"]), "bundle": there("bundle"), "markdown": there("markdown"), "source_artifact": there("source_artifact"), "attachments": [Path(row["bundle"]) / a for a in row["attachments"]]})
