"""Column names: quoting, and names that a table does not use yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns by name, whatever characters the names have."""
    return [F.col(quoted(n)) for n in (df.columns if names is None else names)]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def renamed(names: list[str], taken: list[str]) -> list[str]:
    """Names for kept columns: one that the result itself uses gets ``_source`` behind it, until it is free."""
    out: list[str] = []
    for n in names:
        while n.lower() in {x.lower() for x in [*taken, *out]}:
            n += "_source"
        out.append(n)
    return out
