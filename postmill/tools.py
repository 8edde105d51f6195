"""Conversions as tools for assistants: plain arguments in, text or JSON out; failures raise."""

from __future__ import annotations

import json
import os
import tempfile

from postmill import api
from postmill.operators import sinks
from postmill.options import options_from_preset


def _existing(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def _good(result):
    if not result.success:
        raise RuntimeError(result.error or "conversion failed")
    return result


def convert_eml(eml_path: str, output_path: str | None = None, preset: str = "default", **flags: bool | None) -> str:
    """The Markdown of one message; written to `output_path`, too, if that is given. Flags override the preset."""
    options = options_from_preset(preset, **flags)
    if output_path is not None:
        return _good(api.convert(_existing(eml_path), output=output_path, options=options)).output.read_text(encoding="utf-8")
    with tempfile.TemporaryDirectory() as folder:
        return _good(api.convert(_existing(eml_path), output=folder, options=options)).output.read_text(encoding="utf-8")


def convert_eml_to_bundle(eml_path: str, bundle_root: str, source_handling: str = "copy", preset: str = "default", **flags: bool | None) -> str:
    """JSON with the paths of a bundle and its diagnostics."""
    options = options_from_preset(preset, **flags)
    _existing(eml_path)
    os.makedirs(bundle_root, exist_ok=True)
    made = _good(api.convert_to_bundle(eml_path, bundle_root=bundle_root, options=options, source_handling=source_handling))
    found = {"bundle_path": str(made.bundle), "markdown_path": str(made.markdown), "attachment_paths": [str(a) for a in made.attachments]}
    return json.dumps(found | ({"diagnostics": made.diagnostics} if made.diagnostics else {}), indent=2)


def convert_directory(directory: str, output_directory: str | None = None, dry_run: bool = False, preset: str = "default", **flags: bool | None) -> str:
    """JSON with what became of all messages below a folder."""
    if not os.path.isdir(directory):
        raise FileNotFoundError(directory)
    rows = sinks.convert_dir(api.session(), directory, output=output_directory, options=options_from_preset(preset, dry_run=dry_run, **flags))
    return json.dumps(sinks.directory_summary(rows), indent=2)


def get_diagnostics(eml_path: str, preset: str = "default", **flags: bool | None) -> str:
    """JSON with the diagnostics of a message, from a dry run."""
    result = _good(api.convert(_existing(eml_path), options=options_from_preset(preset, **flags | {"dry_run": True})))
    return json.dumps(result.diagnostics, indent=2)
