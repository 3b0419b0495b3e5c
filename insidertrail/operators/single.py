"""One-row aggregates attached to a table without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def single_row(aggregate: DataFrame) -> Column:
    """The only row of an ungrouped aggregate as a struct column (a scalar subquery)."""
    return aggregate.select(F.struct(*aggregate.columns).alias("row")).scalar()
