"""JSON, XML and pipe-separated documents to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insidertrail.functions import scalars as S

# --- submissions listing: parallel arrays -----------------------------------

LISTING_FIELDS = ["form", "accessionNumber", "filingDate", "primaryDocument", "reportDate", "items"]
LISTING_SCHEMA = ", ".join(f"{f} array<string>" for f in LISTING_FIELDS)


def listing_rows(docs: DataFrame, json: str, forms: list[str], cutoff: Column | None = None) -> DataFrame:
    """One row per listed filing of the wanted forms; short arrays read as ''."""
    parsed = docs.withColumn("_d", F.from_json(json, LISTING_SCHEMA))
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"_d.{f}"), F.array().cast("array<string>")).alias(f)
                            for f in LISTING_FIELDS])
    keep = [c for c in docs.columns if c != json]
    rows = parsed.select(*keep, F.explode(zipped).alias("f")).where(F.col("f.form").isin(forms))
    if cutoff is not None:
        rows = rows.where(S.iso_date(F.col("f.filingDate")) >= cutoff)
    blank = F.lit("")
    return rows.select(*keep, F.col("f.accessionNumber").alias("accession_number"),
                       F.col("f.filingDate").alias("filing_date"),
                       F.coalesce("f.primaryDocument", blank).alias("primary_document"),
                       F.col("f.form").alias("form"), F.coalesce("f.reportDate", blank).alias("report_date"),
                       F.coalesce("f.items", blank).alias("items"))


# --- company facts: nested maps ---------------------------------------------

# Concepts loaded, by namespace (fixed values).
CONCEPTS = {
    "us-gaap": [
        "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax",
        "NetIncomeLoss", "OperatingIncomeLoss",
        "DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet",
        "Assets", "Liabilities", "StockholdersEquity",
        "CashAndCashEquivalentsAtCarryingValue",
        "LongTermDebtNoncurrent", "LongTermDebt",
    ],
    "dei": ["EntityCommonStockSharesOutstanding"],
}
FACTS_SCHEMA = ("facts map<string, map<string, struct<units: map<string, array<struct<"
                "end: string, filed: string, val: double, fp: string, form: string>>>>>>")


def company_facts(docs: DataFrame, json: str) -> DataFrame:
    """Long facts of the loaded concepts; facts without end, filing day or value are dropped."""
    wanted = [f"{ns}:{name}" for ns, names in CONCEPTS.items() for name in names]
    keep = [c for c in docs.columns if c != json]
    spaces = docs.select(*keep, F.explode(F.from_json(json, FACTS_SCHEMA)["facts"]).alias("ns", "concepts"))
    concepts = spaces.select(*keep, "ns", F.explode("concepts").alias("name", "entry"))
    concepts = concepts.withColumn("concept", F.concat_ws(":", "ns", "name")).where(F.col("concept").isin(wanted))
    units = concepts.select(*keep, "concept", F.explode("entry.units").alias("unit", "rows"))
    rows = units.select(*keep, "concept", F.explode("rows").alias("r"))
    return rows.select(*keep, "concept", S.iso_date(F.col("r.end")).alias("period_end"),
                       S.iso_date(F.col("r.filed")).alias("filed_date"), F.col("r.fp").alias("fiscal_period"),
                       F.col("r.form").alias("form"), F.col("r.val").alias("value")).where(
        F.col("period_end").isNotNull() & F.col("filed_date").isNotNull() & F.col("value").isNotNull())


# --- daily short volume: pipe-separated lines -------------------------------


def short_volume_rows(lines: DataFrame, tickers: DataFrame) -> DataFrame:
    """(ticker, date) sums of 'yyyymmdd|symbol|short|exempt|total|...' lines; bad lines are skipped."""
    p = F.split(F.trim("value"), r"\|")

    def whole(i):
        return S.safe_double(F.get(p, F.lit(i))).cast("bigint")

    parsed = lines.select(
        F.upper(F.trim(F.get(p, F.lit(1)))).alias("ticker"),
        F.try_to_date(F.substring(F.get(p, F.lit(0)), 1, 8), "yyyyMMdd").alias("date"),
        whole(2).alias("short_volume"), whole(3).alias("short_exempt_volume"), whole(4).alias("total_volume"),
        F.size(p).alias("_n"))
    good = parsed.where((F.col("_n") >= 5) & F.col("date").isNotNull() & F.col("short_volume").isNotNull()
                        & F.col("short_exempt_volume").isNotNull() & F.col("total_volume").isNotNull())
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return (good.join(wanted, "ticker", "left_semi").groupBy("ticker", "date")
            .agg(*[F.sum(c).alias(c) for c in ("short_volume", "short_exempt_volume", "total_volume")]))


# --- earnings calendar ------------------------------------------------------


def earnings_days(stamps: DataFrame, *, key: str = "company_id", ts: str = "ts", order: str) -> DataFrame:
    """Report day with before-open / after-close hint by hour; midnight means unknown."""
    hour = F.hour(ts)
    hint = F.when(hour == 0, F.lit(None).cast("string")).when(hour < 12, "BMO").otherwise("AMC")
    return (stamps.where(F.col(ts).isNotNull())
            .groupBy(key, F.col(ts).cast("date").alias("earnings_date"))
            .agg(F.min_by(F.struct(hint.alias("report_time")), order).alias("r"))
            .select(key, "earnings_date", "r.report_time"))


# --- ticker lists -----------------------------------------------------------


def universe_tickers(lines: DataFrame) -> DataFrame:
    """Distinct upper-case tickers; blank lines and '#' comments are skipped."""
    text = F.trim("value")
    return (lines.where((text != "") & ~text.startswith("#"))
            .select(F.upper(text).alias("ticker")).distinct())


# --- ownership documents (XML) ----------------------------------------------

_VALUE = "struct<value: string>"
FORM4_SCHEMA = (
    "aff10b5One string, "
    "issuer struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>, "
    "reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, "
    "reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string, "
    "officerTitle: string>>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction: array<struct<"
    f"securityTitle: {_VALUE}, transactionDate: {_VALUE}, "
    "transactionCoding: struct<transactionCode: string>, "
    f"transactionAmounts: struct<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}, "
    f"transactionAcquiredDisposedCode: {_VALUE}>, "
    f"postTransactionAmounts: struct<sharesOwnedFollowingTransaction: {_VALUE}>>>>")


def read_form4(spark: SparkSession, path: str) -> DataFrame:
    """Documents under a path with their file name; unreadable ones keep only ``_corrupt``."""
    schema = T.StructType.fromDDL(FORM4_SCHEMA + ", _corrupt string")
    return (spark.read.format("xml").option("rowTag", "ownershipDocument").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").schema(schema).load(path)
            .withColumn("source_file", F.input_file_name()))


def parse_form4_text(docs: DataFrame, xml: str) -> DataFrame:
    """The same document columns from an XML text column."""
    keep = [c for c in docs.columns if c != xml]
    return docs.select(*keep, F.from_xml(xml, FORM4_SCHEMA).alias("_x")).select(*keep, "_x.*")


def form4_transactions(docs: DataFrame) -> DataFrame:
    """Every (transaction, owner) of documents that carry ``accession`` and ``filing_date``."""
    def yes(col):
        return F.coalesce(F.lower(F.trim(col)).isin("1", "true"), F.lit(False))

    head = docs.where(F.coalesce("issuer.issuerCik", F.lit("")) != "").select(
        "accession", "filing_date", S.plan_flag("aff10b5One").alias("is_10b5_1_plan"),
        F.regexp_replace("issuer.issuerCik", "^0+", "").alias("company_cik"),
        F.col("issuer.issuerName").alias("company_name"),
        F.col("issuer.issuerTradingSymbol").alias("company_ticker"),
        F.col("reportingOwner").alias("owners"),
        F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("m"))
    rows = head.select("*", F.explode("owners").alias("o")).drop("owners")
    shares = F.coalesce(S.safe_double(F.col("m.transactionAmounts.transactionShares.value")), F.lit(0.0))
    price = S.safe_double(F.col("m.transactionAmounts.transactionPricePerShare.value"))
    code = F.trim(F.coalesce("m.transactionCoding.transactionCode", F.lit("")))
    day = F.trim(F.coalesce("m.transactionDate.value", F.lit("")))
    title = F.col("m.securityTitle.value")
    rel = F.col("o.reportingOwnerRelationship")
    return rows.where(code != "").select(
        F.regexp_replace(F.coalesce("o.reportingOwnerId.rptOwnerCik", F.lit("")), "^0+", "").alias("insider_cik"),
        F.coalesce("o.reportingOwnerId.rptOwnerName", F.lit("")).alias("insider_name"),
        yes(rel["isOfficer"]).alias("is_officer"), yes(rel["isDirector"]).alias("is_director"),
        yes(rel["isTenPercentOwner"]).alias("is_ten_pct_owner"),
        F.coalesce(rel["officerTitle"], F.lit("")).alias("officer_title"),
        "company_cik", "company_name", "company_ticker",
        F.concat_ws("_", "accession", code, day, S.float_text(shares)).alias("accession_number"),
        "filing_date", S.iso_date(day).alias("transaction_date"), code.alias("transaction_code"),
        shares.alias("shares"), price.alias("price_per_share"), S.total_value(shares, price).alias("total_value"),
        S.safe_double(F.col("m.postTransactionAmounts.sharesOwnedFollowingTransaction.value"))
        .alias("shares_owned_after"),
        F.coalesce("m.transactionAmounts.transactionAcquiredDisposedCode.value", F.lit(""))
        .alias("acquired_or_disposed"),
        S.is_discretionary(code).alias("is_discretionary"), title.alias("security_title"),
        S.is_common_stock(title).alias("is_common_stock"), "is_10b5_1_plan")
