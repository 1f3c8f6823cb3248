"""Text and duration functions, all built from JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The name of the top scope, the id placeholder, the units of time in seconds.
ROOT = "root"
ID_PLACEHOLDER = "{record_id}"
MINUTE, HOUR, DAY = 60, 3600, 86400


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def prefix(path: ColumnOrName) -> Column:
    """Base name without its last extension; leading dots do not start one."""
    return F.regexp_replace(_base_name(_col(path)), r"^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: ColumnOrName) -> Column:
    """Last extension of the base name with its dot, or an empty string."""
    name = _base_name(_col(path))
    return F.substr(name, F.length(prefix(path)) + 1)


def strip_suffix(name: ColumnOrName, suffix: ColumnOrName) -> Column:
    """``name`` without ``suffix`` at its end; other occurrences stay."""
    name = _col(name)
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    kept = F.substr(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(F.endswith(name, suffix), kept).otherwise(name)


def export_name(path: ColumnOrName, step: str | Column) -> Column:
    """Name of an exported file: ``base.STEP.ext``."""
    step = F.lit(step) if isinstance(step, str) else step
    return F.concat(prefix(path), F.lit("."), step, extension(path))


def split_flags(text: ColumnOrName) -> Column:
    """Tokens between single spaces, empties dropped; NULL gives an empty array."""
    tokens = F.array_remove(F.split(_col(text), " "), "")
    return F.coalesce(tokens, F.array().cast("array<string>"))


def split_data(text: ColumnOrName) -> Column:
    """Tokens between single spaces, empties kept."""
    return F.split(_col(text), " ")


def data_files(text: ColumnOrName) -> Column:
    """File names to check among ``split_data``: of ``a:b`` the part after the colon."""
    return F.transform(
        split_data(text),
        lambda t: F.when(F.contains(t, F.lit(":")), F.split_part(t, F.lit(":"), F.lit(2))).otherwise(t),
    )


def duration_unit(seconds: ColumnOrName) -> Column:
    """``d``, ``h``, ``m`` or ``s``; a unit is used only beyond one whole unit."""
    s = _col(seconds)
    return (
        F.when(s > DAY, "d").when(s > HOUR, "h").when(s > MINUTE, "m").when(s.isNotNull(), "s")
    )


def duration_value(seconds: ColumnOrName) -> Column:
    """``seconds`` expressed in its :func:`duration_unit`."""
    s = _col(seconds).cast("double")
    return F.when(s > DAY, s / DAY).when(s > HOUR, s / HOUR).when(s > MINUTE, s / MINUTE).otherwise(s)


def fill_template(template: ColumnOrName, record_id: ColumnOrName = "record_id") -> Column:
    """Replace ``{record_id}`` in a template (a literal when given as ``str``)."""
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(template, F.lit(ID_PLACEHOLDER), _col(record_id))


def scoped_name(scope: ColumnOrName, name: ColumnOrName) -> Column:
    """``scope.name``, or the bare name in the root scope."""
    scope, name = _col(scope), _col(name)
    return F.when(scope == ROOT, name).otherwise(F.concat_ws(".", scope, name))


def is_true(value: ColumnOrName) -> Column:
    """Whether a setting reads ``true`` in any case; NULL is false."""
    return F.coalesce(F.lower(_col(value).cast("string")) == "true", F.lit(False))


def glob_to_regex(pattern: str, start: bool = True) -> str:
    """Regular expression of a shell glob, anchored at neither end.

    ``*`` and ``?`` stay within a path segment and a leading one does not match a dot file;
    ``start`` says whether the pattern begins a segment.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2)
        hidden = r"(?!\.)" if start else ""
        if ch == "*":
            out.append(hidden + "[^/]*")
        elif ch == "?":
            out.append(hidden + "[^/]")
        elif ch == "[" and end != -1:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = "^" + body[1:] if body[0] == "!" else body.replace("^", "\\^")
            out.append(f"{hidden}(?!/)[{body}]")
            i = end
        else:
            out.append(re.escape(ch))
        start = ch == "/"
        i += 1
    return "".join(out)
