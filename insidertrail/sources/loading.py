"""Idempotent loads, dimensions and repairs of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S


def upsert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], *, order: str) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each key by ``order``."""
    rest = [c for c in incoming.columns if c not in keys]
    first = (incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
             .select(*keys, "_r.*"))
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def append_absent(path: str, existing: DataFrame, incoming: DataFrame, keys: list[str], *, order: str,
                  partition_by: list[str] | None = None) -> None:
    writer = upsert_absent(existing, incoming, keys, order=order).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stable_id(*cols: str) -> Column:
    """Non-negative 63-bit id that does not depend on load order."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def insider_dimension(rows: DataFrame, *, order: str) -> DataFrame:
    first = rows.groupBy("insider_cik").agg(F.min_by("insider_name", order).alias("name"))
    return first.select(stable_id("insider_cik").alias("insider_id"), F.col("insider_cik").alias("cik"),
                        "name", S.is_institution("name").alias("is_institution"))


def company_dimension(rows: DataFrame, *, order: str) -> DataFrame:
    first = rows.groupBy("company_cik").agg(
        F.min_by(F.struct("company_ticker", "company_name"), order).alias("f"))
    return first.select(stable_id("company_cik").alias("company_id"), F.col("company_cik").alias("cik"),
                        F.col("f.company_ticker").alias("ticker"), F.col("f.company_name").alias("name"))


def role_dimension(rows: DataFrame, *, order: str) -> DataFrame:
    """First seen role per (insider, company); the last filing day keeps moving forward."""
    seen = F.struct("officer_title", "is_officer", "is_director", "is_ten_pct_owner", "filing_date")
    first = rows.groupBy("insider_cik", "company_cik").agg(
        F.min_by(seen, order).alias("f"), F.max("filing_date").alias("last_filing_date"))
    return first.select(
        "insider_cik", "company_cik",
        S.role_title_or_fallback(F.col("f.officer_title"), F.col("f.is_director"), F.col("f.is_ten_pct_owner"))
        .alias("role_title"),
        F.col("f.is_officer").alias("is_officer"), F.col("f.is_director").alias("is_director"),
        F.col("f.is_ten_pct_owner").alias("is_ten_percent_owner"),
        F.col("f.filing_date").alias("first_filing_date"), "last_filing_date")


def details_to_load(details: DataFrame, transactions: DataFrame, loaded: DataFrame) -> DataFrame:
    """Detail rows of filings we hold transactions for and have not loaded before."""
    held = transactions.select(S.raw_accession("accession_number").alias("accession_number")).distinct()
    return (details.join(held, "accession_number", "left_semi")
            .join(loaded.select("accession_number").distinct(), "accession_number", "left_anti"))


def fill_plan_flags(transactions: DataFrame, submissions: DataFrame, *, order: Column | str) -> DataFrame:
    """NULL plan flags filled from filings with the same accession; the last filing by ``order`` wins."""
    flag = S.plan_flag("AFF10B5ONE")
    pick = F.max_by(flag, order)
    known = (submissions.where(flag.isNotNull() & (F.trim("ACCESSION_NUMBER") != ""))
             .groupBy(F.trim("ACCESSION_NUMBER").alias("_acc")).agg(pick.alias("_flag")))
    prefix = F.when(F.col("accession_number").contains("_"), S.raw_accession("accession_number"))
    return (transactions.withColumn("_acc", prefix).join(known, "_acc", "left")
            .withColumn("is_10b5_1_plan", F.coalesce("is_10b5_1_plan", "_flag")).drop("_acc", "_flag"))


def fill_sectors(companies: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sector and industry from a (ticker, sector, industry) lookup where the sector is missing."""
    found = lookup.where(F.col("sector").isNotNull()).groupBy("ticker").agg(
        F.min(F.struct("sector", "industry")).alias("_l"))
    missing = F.coalesce(F.col("sector"), F.lit("")) == ""
    take = missing & F.col("_l").isNotNull()
    return (companies.join(found, "ticker", "left").withColumns({
        "industry": F.when(take, F.col("_l.industry")).otherwise(F.col("industry")),
        "sector": F.when(take, F.col("_l.sector")).otherwise(F.col("sector"))}).drop("_l"))


def loaded_tickers(companies: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every ticker with whether any of its transactions are stored."""
    held = transactions.select("company_id").distinct().withColumn("_has", F.lit(True))
    return companies.join(held, "company_id", "left").groupBy("ticker").agg(
        F.coalesce(F.max("_has"), F.lit(False)).alias("loaded"))
