"""Column references by exact name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column reference that treats dots, spaces and percent signs as part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted_all(names: Iterable[str]) -> list[Column]:
    return [quoted(n) for n in names]


def unused_names(df, *wanted: str) -> dict[str, str]:
    """For each wanted name one that no column of ``df`` has (whatever the case), for columns of a function's own."""
    taken, out = {c.lower() for c in df.columns}, {}
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out[w] = name
    return out
