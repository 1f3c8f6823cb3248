"""Column functions on names, paths, settings text and durations."""

from recordflow.functions.text import (
    duration_unit,
    duration_value,
    export_name,
    fill_template,
    glob_to_regex,
    is_true,
    prefix,
    data_files,
    scoped_name,
    split_data,
    split_flags,
    strip_suffix,
)

__all__ = [
    "duration_unit",
    "duration_value",
    "export_name",
    "fill_template",
    "glob_to_regex",
    "is_true",
    "prefix",
    "data_files",
    "scoped_name",
    "split_data",
    "split_flags",
    "strip_suffix",
]
