"""python -m postmill convert PATH [--output DIR] [--report] [options] | doctor [--json]; a bare path means convert."""

from __future__ import annotations

import argparse
import importlib.util
import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from dataclasses import fields

from postmill.options import PRESETS, ConvertOptions, options_from_preset

#: Where the settings of the workflow are kept, unless the environment says otherwise.
SETTINGS = "~/.config/postmill/settings.json"
NEEDED, EXTRAS = ("pyspark", "pyarrow", "pandas", "yaml"), ("duckdb", "numpy", "regex")


def _row(name: str, status: str, message: str, fix: str | None = None) -> dict:
    return {"name": name, "status": status, "message": message, "fix": fix}


def _modules(name: str, modules: tuple[str, ...], none: str) -> dict:
    gone = [m for m in modules if importlib.util.find_spec(m) is None]
    if not gone:
        return _row(name, "ok", ", ".join(modules))
    status = none if len(gone) == len(modules) else "err"
    return _row(name, status, f"not installed: {', '.join(gone)}", f"install {gone[0]}" if status == "err" else None)


def _writable(path: str) -> bool:
    try:
        with tempfile.NamedTemporaryFile(dir=path, prefix=".postmill-doctor-"):
            return True
    except OSError:
        return False


def _readable(path: str) -> bool:
    return os.access(path, os.R_OK | os.X_OK)


def _folder(name: str, path: str | None, usable: Callable[[str], bool], what: str) -> dict:
    if path is None:
        return _row(name, "skip", "not configured")
    if not os.path.exists(path):
        return _row(name, "err", f"{path} does not exist", f"mkdir -p {path}")
    if not os.path.isdir(path):
        return _row(name, "err", f"{path} is no folder", "name a folder")
    return _row(name, "ok", f"{path} is {what}") if usable(path) else _row(name, "err", f"{path} is not {what}", f"look at the permissions of {path}")


def checks(settings: str | None = None) -> list[dict]:
    """A row (name, status, message, fix) for each thing that is needed; status is ok, err or skip."""
    from postmill.operators.jobs import load_settings

    known = load_settings(os.path.expanduser(settings or os.environ.get("POSTMILL_SETTINGS", SETTINGS))) or {}
    return [
        _row("python", "ok" if sys.version_info >= (3, 12) else "err", sys.version.split()[0], None if sys.version_info >= (3, 12) else "use Python 3.12 or later"),
        _modules("core_dependencies", NEEDED, "err"),
        _modules("extras", EXTRAS, "skip"),
        _folder("inbox_path", known.get("inbox_path"), _readable, "readable"),
        _folder("cabinet_path", known.get("cabinet_path"), _writable, "writable"),
    ]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("postmill", description="Convert .eml files to Markdown.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="check what is needed").add_argument("--json", action="store_true")
    run = commands.add_parser("convert", help="convert a file or a folder")
    run.add_argument("path")
    run.add_argument("--output")
    run.add_argument("--preset", choices=sorted(PRESETS), help="a set of options to which the others are added")
    for f in fields(ConvertOptions):
        run.add_argument("--" + f.name.replace("_", "-"), action="store_true")
    return top


def chosen(args: argparse.Namespace) -> ConvertOptions:
    """The options of a command line; a dry run deletes nothing."""
    on = {f.name: True for f in fields(ConvertOptions) if getattr(args, f.name)}
    if args.dry_run:
        on.pop("delete_eml", None)
    return options_from_preset(args.preset, **on) if args.preset else ConvertOptions(**on)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in ("convert", "doctor", "-h", "--help"):
        argv.insert(0, "convert")
    args = parser().parse_args(argv)
    if args.command == "doctor":
        rows = checks()
        print(json.dumps(rows, indent=2) if args.json else "\n".join(f"{r['status']:4} {r['name']}: {r['message']}" + (f" ({r['fix']})" if r["fix"] else "") for r in rows))
        return int(any(r["status"] == "err" for r in rows))
    from postmill.api import session
    from postmill.operators.sinks import build_report, convert, convert_dir, report_folder, write_report

    options, began = chosen(args), time.time()
    folder = os.path.isdir(args.path)
    try:
        results = convert_dir(session(), args.path, output=args.output, options=options) if folder else [convert(session(), args.path, output=args.output, options=options)]
    except (FileNotFoundError, ValueError) as e:
        print(f"err {e}", file=sys.stderr)
        return 1
    for r in results:
        print(f"{'ok ' if r['success'] else 'err'} {r['source']} -> {r['output'] or r['error'] or 'not written'}")
    if options.report:
        at = report_folder(args.path, args.output)
        os.makedirs(at, exist_ok=True)
        report = build_report(session(), results, options, input_path=os.path.realpath(args.path), input_mode="directory" if folder else "file", duration_ms=round(1000 * (time.time() - began)), folder=at)
        print(write_report(report, at, ".postmill-report.json"))
    return int(any(not r["success"] for r in results))


if __name__ == "__main__":
    sys.exit(main())
