"""Point-in-time context of trades: fundamentals, short volume, filing events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.operators import asof


def facts_as_of(trades: DataFrame, facts: DataFrame, concepts: dict[str, str], *,
                on: str = "transaction_date") -> DataFrame:
    """Latest known fact per concept for each distinct (company, trade day).

    Only facts filed on or before the day count; among those the latest period
    wins, then the latest filing.  One struct column per concept, null where none is known.  Trades without
    a company or day know nothing and get no row.
    """
    # One merge of facts and asked days per company, whatever the number of concepts.  A filing day is one row with
    # a slot per concept; each slot's running best is a maximum, so amendments and late filings need no second look.
    fact = F.struct("period_end", "filed_date", "value")
    slots = {name: F.max(F.when(F.col("concept") == concept, fact)).alias(name) for concept, name in concepts.items()}
    daily = (facts.where(F.col("concept").isin(list(concepts)) & F.col("company_id").isNotNull() & F.col("filed_date").isNotNull())
             .groupBy("company_id", F.col("filed_date").alias("day")).agg(*slots.values()))
    asked = (trades.select("company_id", F.col(on).alias("day")).where(F.col("company_id").isNotNull() & F.col("day").isNotNull())
             .distinct().withColumn("asked", F.lit(True)))
    both = daily.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    # Of a day its filings come first.
    w = W.partitionBy("company_id").orderBy("day", "asked").rowsBetween(W.unboundedPreceding, 0)
    known = both.withColumns({name: F.max(name).over(w) for name in slots}).where("asked")
    return known.select("company_id", F.col("day").alias(on), *slots)


def short_pressure(trades: DataFrame, short_volume: DataFrame, *, on: str = "trade_date") -> DataFrame:
    """Short share of volume on the last reported day before the trade."""
    found = asof.bracket(trades.select("ticker", F.col(on).alias("as_of")), short_volume,
                         values=["short_volume", "total_volume"], next=False, strict=True)
    ratio = F.col("prev.short_volume") / F.nullif(F.col("prev.total_volume"), F.lit(0))
    return asof.attach(trades, found, on=on).select(
        *trades.columns, F.col("prev.date").alias("pressure_date"), ratio.alias("short_ratio"))


def filing_event_context(trades: DataFrame, events: DataFrame, *, on: str) -> DataFrame:
    """Next results release after the day and last activist filing up to it."""
    def days(condition):
        return events.where(condition).select("company_id", F.col("filing_date").alias("date")).distinct()

    asked = trades.select("company_id", F.col(on).alias("as_of"))
    results = asof.bracket(asked, days((F.col("form_type") == "8-K") & F.col("items").contains("2.02")),
                           key="company_id", values=[], prev=False, strict=True)
    activist = asof.bracket(asked, days(F.col("form_type") == "SC 13D"),
                            key="company_id", values=[], next=False)
    out = asof.attach(trades, results, key="company_id", on=on)
    out = asof.attach(out, activist, key="company_id", on=on)
    return out.select(*trades.columns, F.col("next.date").alias("next_results"),
                      F.col("prev.date").alias("last_activist"))
