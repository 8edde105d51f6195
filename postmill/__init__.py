"""Postmill: mail and document processing as PySpark DataFrame transforms."""

from postmill.api import BundleResult, ConvertResult, convert, convert_dir, convert_to_bundle
from postmill.options import ConvertOptions

__all__ = ["BundleResult", "ConvertOptions", "ConvertResult", "convert", "convert_dir", "convert_to_bundle"]
