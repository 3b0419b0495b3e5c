"""Company filing events (8-K items, 13D/13G) from submission listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.functions.scalars import blank_to_null, iso_date


def normalise_filing_events(raw: DataFrame, *, order: str, stored: DataFrame | None = None) -> DataFrame:
    """Typed events, the first row of each accession; undated events are dropped.

    The first row decides: if it has no usable date the accession is skipped.
    """
    rest = ["company_id", "form", "filing_date", "report_date", "items"]
    named = raw.where(F.coalesce("accession_number", F.lit("")) != "")
    if stored is not None:
        named = named.join(stored.select("accession_number").distinct(), "accession_number", "left_anti")
    first = named.groupBy("accession_number").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return (first.select("accession_number", "r.*")
            .select("accession_number", "company_id", F.col("form").alias("form_type"),
                    iso_date("filing_date").alias("filing_date"), iso_date("report_date").alias("report_date"),
                    blank_to_null("items").alias("items"))
            .where(F.col("filing_date").isNotNull()))
