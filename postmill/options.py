"""Conversion options and presets."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ConvertOptions:
    strip_signatures: bool = False
    strip_disclaimers: bool = False
    strip_quoted_headers: bool = False
    strip_signature_images: bool = False
    strip_tracking_pixels: bool = False
    embed_inline_images: bool = False
    include_all_headers: bool = False
    include_raw_html: bool = False
    no_calendar_summary: bool = False
    allow_fallback_on_html_error: bool = False
    allow_html_repair_on_panic: bool = False
    delete_eml: bool = False
    dry_run: bool = False
    report: bool = False

    @property
    def strips_images(self) -> bool:
        return self.strip_signature_images or self.strip_tracking_pixels


#: The flags that each preset turns on.
_CORE = ("strip_signatures", "strip_tracking_pixels", "strip_signature_images")
PRESETS = {
    "default": _CORE,
    "clean": (*_CORE, "strip_disclaimers", "strip_quoted_headers"),
    "verbose": ("include_all_headers", "include_raw_html"),
    "raw": (),
}


def options_from_preset(name: str = "default", **overrides: bool | None) -> ConvertOptions:
    """A preset (an unknown name means default) with overrides; the two resilience flags are always on."""
    known = {f.name for f in fields(ConvertOptions)}
    if unknown := set(overrides) - known:
        raise TypeError(f"unknown options: {sorted(unknown)}")
    chosen = dict.fromkeys(PRESETS.get(name, PRESETS["default"]), True) | {k: v for k, v in overrides.items() if v is not None}
    return ConvertOptions(**{**chosen, "allow_fallback_on_html_error": True, "allow_html_repair_on_panic": True})
