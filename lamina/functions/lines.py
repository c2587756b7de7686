"""Markdown as lines: a small grammar of headings, labelled lines and backticked items. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def of(md: Column) -> Column:
    """The lines of a document; none for null."""
    return F.split(F.coalesce(md, F.lit("")), "\n")


def after(lines: Column, prefix: str) -> Column:
    """The rest of the first line that starts with the prefix; '' without one."""
    own = F.get(F.filter(lines, lambda s: s.startswith(prefix)), F.lit(0))
    return F.coalesce(F.substr(own, F.lit(len(prefix) + 1)), F.lit(""))


def field(lines: Column, label: str) -> Column:
    """The value of the first line `**label**：value` (either colon), trimmed; '' without one."""
    rest = text.trim(after(lines, f"**{label}**"))
    return F.when(rest.startswith("：") | rest.startswith(":"), text.trim(F.substr(rest, F.lit(2)))).otherwise("")


def quoted(value: Column) -> Column:
    """What stands between pairs of backticks, but for empty pairs."""
    parts = F.split(value, "`")
    return F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1) & (p != ""))
