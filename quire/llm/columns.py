"""Columns of a caller's table, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def own(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
