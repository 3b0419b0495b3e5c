"""Text-shaped inputs (bulk rows, JSON, XML, pipe files) derived from the test tables.

The test data holds no filings, so each reader is fed documents that Spark builds
from the adapter tables; their number grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.plans.adapter import Tables


def raw_filing_events(t: Tables) -> DataFrame:
    """Event rows as text: repeated accessions, blank dates, padded items."""
    e = t.base("events")
    k = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(
        k.alias("seq"), (k % 25).cast("int").alias("company_id"),
        F.when(k % 4 == 1, "SC 13D").when(k % 4 == 2, "SC 13G").otherwise("8-K").alias("form"),
        F.concat(F.lit("E"), F.floor(k / 2).cast("string")).alias("accession_number"),
        F.when(k % 13 == 0, "").when(k % 17 == 0, "n/a").otherwise(day).alias("filing_date"),
        F.when(k % 7 == 0, " ").otherwise(day).alias("report_date"),
        F.when(k % 3 == 0, " 2.02,9.01 ").when(k % 3 == 1, "").otherwise("5.02").alias("items"))


def filing_events(t: Tables) -> DataFrame:
    from insidertrail.sources.filing_events import normalise_filing_events

    return normalise_filing_events(raw_filing_events(t), order="seq")


def _id(t: Tables) -> DataFrame:
    return t.transactions.withColumn("k", F.col("txn_id"))


def _bulk_day(col: str):
    return F.upper(F.date_format(col, "dd-MMM-yyyy"))


def raw_submissions(t: Tables) -> DataFrame:
    k = F.col("k")
    return _id(t).select(
        F.concat(F.lit(" "), "accession_number").alias("ACCESSION_NUMBER"),
        F.when(k % 19 == 0, "4/A").otherwise("4").alias("DOCUMENT_TYPE"), F.lit("").alias("FORM_TYPE"),
        F.lpad((F.col("company_id") + 1000).cast("string"), 10, "0").alias("ISSUERCIK"),
        F.concat(F.lit("Company "), F.col("company_id").cast("string")).alias("ISSUERNAME"),
        F.concat(F.lit(" t"), F.col("company_id").cast("string")).alias("ISSUERTRADINGSYMBOL"),
        F.when(k % 23 == 0, "bad").otherwise(_bulk_day("filing_date")).alias("FILING_DATE"),
        F.when(k % 3 == 0, "").otherwise(_bulk_day("transaction_date")).alias("PERIOD_OF_REPORT"),
        F.when(k % 5 == 0, "1").when(k % 5 == 1, "").when(k % 5 == 2, "0").when(k % 5 == 3, "TRUE")
        .otherwise(" false ").alias("AFF10B5ONE"),
        F.when(k % 4 == 0, " note ").otherwise("  ").alias("REMARKS"))


def raw_owners(t: Tables) -> DataFrame:
    k = F.col("k")
    first = _id(t).select("*", F.lit(0).alias("slot"))
    second = _id(t).where(k % 10 == 0).select("*", F.lit(1).alias("slot"))
    who = F.col("insider_id") + 5000 + 1000 * F.col("slot")
    return first.unionByName(second).select(
        F.col("accession_number").alias("ACCESSION_NUMBER"), F.lpad(who.cast("string"), 10, "0").alias("RPTOWNERCIK"),
        F.concat(F.when(F.col("insider_id") % 17 == 0, "Fund LLC ").otherwise("Person "),
                 who.cast("string")).alias("RPTOWNERNAME"),
        F.when(k % 3 == 0, "Director, Officer").when(k % 3 == 1, "TenPercentOwner").otherwise("Director")
        .alias("RPTOWNER_RELATIONSHIP"),
        F.when(k % 3 == 0, "CEO").otherwise("").alias("RPTOWNER_TITLE"))


def raw_trades(t: Tables) -> DataFrame:
    k = F.col("k")
    return _id(t).select(
        F.col("accession_number").alias("ACCESSION_NUMBER"), F.col("transaction_code").alias("TRANS_CODE"),
        _bulk_day("transaction_date").alias("TRANS_DATE"),
        F.when(k % 29 == 0, "").otherwise(F.col("shares").cast("bigint").cast("string")).alias("TRANS_SHARES"),
        F.when(k % 31 == 0, "n/a").otherwise((k % 90 + 10).cast("string")).alias("TRANS_PRICEPERSHARE"),
        F.when(F.col("transaction_code") == "P", "A").otherwise("D").alias("TRANS_ACQUIRED_DISP_CD"),
        F.col("shares_owned_after").cast("bigint").cast("string").alias("SHRS_OWND_FOLWNG_TRANS"),
        F.when(k % 7 == 0, "Preferred Stock").when(k % 7 == 1, "  ").otherwise("Common Stock")
        .alias("SECURITY_TITLE"))


def raw_derivatives(t: Tables) -> DataFrame:
    k = F.col("k")
    return _id(t).select(
        F.col("accession_number").alias("ACCESSION_NUMBER"),
        F.when(k % 37 == 0, "").otherwise(k.cast("string")).alias("DERIV_TRANS_SK"),
        F.lit("Stock Option").alias("SECURITY_TITLE"), _bulk_day("transaction_date").alias("TRANS_DATE"),
        F.lit("M").alias("TRANS_CODE"), (k % 50).cast("string").alias("CONV_EXERCISE_PRICE"),
        F.col("shares").cast("bigint").cast("string").alias("TRANS_SHARES"), F.lit("").alias("TRANS_PRICEPERSHARE"),
        F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"), _bulk_day("filing_date").alias("EXCERCISE_DATE"),
        F.when(k % 2 == 0, "").otherwise(_bulk_day("filing_date")).alias("EXPIRATION_DATE"),
        F.col("shares").cast("bigint").cast("string").alias("UNDLYNG_SEC_SHARES"),
        F.lit(None).cast("string").alias("SHRS_OWND_FOLWNG_TRANS"), F.lit(" E ").alias("TRANS_TIMELINESS"))


def raw_footnotes(t: Tables) -> DataFrame:
    return t.footnotes.select(
        F.col("accession_number").alias("ACCESSION_NUMBER"), F.col("footnote_id").alias("FOOTNOTE_ID"),
        F.concat(F.lit("  "), F.col("text")).alias("FOOTNOTE_TXT"))


def listing_docs(t: Tables) -> DataFrame:
    """One parallel-array listing per transaction; later arrays are shorter."""
    day = F.col("filing_date").cast("string")
    acc = F.col("accession_number")
    json = F.concat(F.lit('{"form":["4","8-K","3"],"accessionNumber":["'), acc, F.lit('","'), acc, F.lit('b","'),
                    acc, F.lit('c"],"filingDate":["'), day, F.lit('","'), day, F.lit('","'), day,
                    F.lit('"],"primaryDocument":["doc.xml"],"items":["","2.02"]}'))
    return t.transactions.select("company_id", json.alias("json"))


def facts_docs(t: Tables) -> DataFrame:
    """One company-facts document per (company, quarter)."""
    row = F.concat(F.lit('{"end":"'), F.col("period_end").cast("string"), F.lit('","filed":"'),
                   F.col("filed_date").cast("string"), F.lit('","fp":"Q1","form":"10-Q","val":'),
                   F.format_string("%.2f", "value"), F.lit("}"))
    json = F.concat(F.lit('{"facts":{"us-gaap":{"Revenues":{"units":{"USD":['), row,
                    F.lit(',{"end":"2000-01-01","val":1}]}},"Goodwill":{"units":{"USD":['), row,
                    F.lit(']}}},"dei":{"EntityCommonStockSharesOutstanding":{"units":{"shares":['), row,
                    F.lit("]}}}}}"))
    return t.fundamentals.select("company_id", json.alias("json"))


def short_volume_lines(t: Tables) -> DataFrame:
    """Daily pipe lines with a header, a broken line and every symbol listed twice."""
    sv = t.short_volume
    line = F.concat_ws("|", F.date_format("date", "yyyyMMdd"), F.lower("ticker"), F.col("short_volume").cast("string"),
                       F.lit("1"), F.concat(F.col("total_volume").cast("string"), F.lit(".0")), F.lit("B"))
    broken = F.concat_ws("|", F.date_format("date", "yyyyMMdd"), F.col("ticker"), F.lit("x"), F.lit("1"), F.lit("2"))
    header = F.lit("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market")
    return sv.select(F.explode(F.array(line, line, broken, header)).alias("value"))


def form4_docs(t: Tables) -> DataFrame:
    """One ownership document per transaction with two owners and two transactions."""
    k = F.col("txn_id").cast("string")
    who = F.col("insider_id").cast("string")

    def owner(suffix, officer):
        return F.concat(F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>000"), who, F.lit(suffix),
                        F.lit("</rptOwnerCik><rptOwnerName>Person "), who, F.lit(suffix),
                        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isOfficer>"),
                        F.lit(officer), F.lit("</isOfficer><officerTitle>CFO</officerTitle>"
                                              "</reportingOwnerRelationship></reportingOwner>"))

    def move(code, shares, price):
        return F.concat(
            F.lit("<nonDerivativeTransaction><securityTitle><value>Common Stock</value></securityTitle>"
                  "<transactionDate><value>"), F.col("transaction_date").cast("string"),
            F.lit("</value></transactionDate><transactionCoding><transactionCode>"), F.lit(code),
            F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), shares,
            F.lit("</value></transactionShares><transactionPricePerShare><value>"), price,
            F.lit("</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value>"
                  "</transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"))

    shares = F.col("shares").cast("bigint").cast("string")
    xml = F.concat(
        F.lit("<ownershipDocument><aff10b5One>"), (F.col("txn_id") % 2).cast("string"),
        F.lit("</aff10b5One><issuer><issuerCik>00"), (F.col("company_id") + 1000).cast("string"),
        F.lit("</issuerCik><issuerName>Company</issuerName><issuerTradingSymbol>T"),
        F.col("company_id").cast("string"), F.lit("</issuerTradingSymbol></issuer>"),
        owner("1", "1"), owner("2", "0"), F.lit("<nonDerivativeTable>"),
        move("P", shares, F.lit("12.5")), move("M", F.lit("500"), F.lit("0")),
        F.lit("</nonDerivativeTable></ownershipDocument>"))
    return t.transactions.select(F.col("accession_number").alias("accession"), "filing_date", xml.alias("xml"))
