"""Cells that several formats share."""

from __future__ import annotations

import os
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(cc: float) -> str:
    return f"{cc:g}" if cc == int(cc) else f"{cc:.1f}"


def score(value: float | None) -> str:
    return "-" if value is None else f"{value:.1f}"


def change(value: float | None) -> str:
    """With one decimal, or three where one would show no change."""
    if value is None:
        return "-"
    return f"{value:+.3f}" if value and f"{abs(value):.1f}" == "0.0" else f"{value:+.1f}"


def percent(value: float | None) -> str:
    return "-" if value is None else f"{value:.1f}%"


def ranges(found: list, most: int = 3) -> str:
    """The first runs of lines, and how many more."""
    shown = [f"{a}" if a == b else f"{a}-{b}" for a, b in ((r["start"], r["end"]) for r in found or [])]
    return ", ".join(shown[:most]) + (f" +{len(shown) - most} more" if len(shown) > most else "")


def bar(value: float | None, cells: int) -> str:
    """A bar of coverage; a half cell counts up."""
    filled = 0 if value is None else int(min(100.0, max(0.0, value)) / 100 * cells + 0.5)
    return "#" * filled + "." * (cells - filled)


def relative(path: str, *roots: str) -> str:
    """The path below the first root that holds it."""
    path = path.replace("\\", "/")
    for root in roots:
        start = root.replace("\\", "/").rstrip("/") + "/"
        if root and path.startswith(start):
            return path[len(start) :]
    return path


def link(repository: str | None, revision: str, path: str, line: int) -> str | None:
    """The address of a line; none for paths that are not below the repository."""
    if not repository or os.path.isabs(path) or path.split("/")[0] == "..":
        return None
    return f"{repository.rstrip('/')}/blob/{quote(revision, safe='')}/{quote(path)}#L{line}"


def escaped(column: Column, in_property: bool = False) -> Column:
    """A workflow command's text: per cent signs and line ends; in a property also colons and commas."""
    #: Characters and their escapes.
    table = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if in_property else [])
    for char, code in table:
        column = F.replace(column, F.lit(char), F.lit(code))
    return column


def reason(row: Mapping) -> str:
    """One reason as text: what it was and is, or the limit that a new function passes."""
    if row["baseline"] is not None:
        return f"{row['signal']} {row['baseline']} -> {row['value']}"
    limit = row.get("limit") if hasattr(row, "get") else None
    return row["signal"] if row["value"] is None else f"{row['signal']} {row['value']}" + (f" (limit {limit})" if limit else "")
