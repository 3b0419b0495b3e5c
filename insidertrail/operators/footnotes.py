"""Footnote classes rolled up to filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.functions.scalars import MECHANICAL_PATTERNS, footnote_classes


def with_classes(footnotes: DataFrame) -> DataFrame:
    """Adds the footnote class columns."""
    return footnotes.withColumns(footnote_classes("text"))


def filing_rollup(footnotes: DataFrame) -> DataFrame:
    """Per filing: any plan mention, any negated mention, the sorted set of mechanical kinds.

    Kinds are kept as one boolean each until the end, so the aggregation buffer
    has a fixed size however many footnotes a filing has.
    """
    rows = with_classes(footnotes).select("accession_number", F.col("is_plan").alias("p"),
                                          F.col("plan_negated").alias("n"), F.col("mechanical_kinds").alias("k"))
    kinds = [kind for kind, _ in MECHANICAL_PATTERNS]
    agg = rows.groupBy("accession_number").agg(
        F.bool_or("p").alias("fn_plan"), F.bool_or("n").alias("fn_plan_negated"),
        *[F.bool_or(F.array_contains("k", kind)).alias(kind) for kind in kinds])
    found = F.array_compact(F.array(*[F.when(F.col(kind), F.lit(kind)) for kind in sorted(kinds)]))
    return agg.select("accession_number", "fn_plan", "fn_plan_negated",
                      (F.size(found) > 0).alias("fn_mechanical"), found.alias("fn_mechanical_kinds"))
