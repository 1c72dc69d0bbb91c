"""Small frames next to large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of a one-row frame, as a scalar subquery and not as a join without a condition."""
    values = one.select(F.struct(*one.columns)).scalar()
    return rows.select("*", *[values[c].alias(c) for c in one.columns])
