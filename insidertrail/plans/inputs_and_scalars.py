"""Queries on readers, loads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators import prices as P
from insidertrail.plans import raw_inputs as R
from insidertrail.plans.helpers import rounded, scores
from insidertrail.plans.registry import query
from insidertrail.sources import bulk, documents, loading

# --- sources ----------------------------------------------------------------

_BULK_SQL = """
SELECT t.txn_id AS k, t.accession_number AS acc, CAST(1000 + t.company_id AS VARCHAR) AS company_cik,
  concat('Company ', t.company_id) AS company_name, concat('T', t.company_id) AS company_ticker,
  CASE WHEN t.txn_id % 23 = 0 THEN NULL ELSE t.filing_date END AS filing_date,
  CASE t.txn_id % 5 WHEN 0 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS is_10b5_1_plan,
  CAST(t.insider_id + 5000 + 1000 * s.slot AS VARCHAR) AS insider_cik,
  concat(CASE WHEN t.insider_id % 17 = 0 THEN 'Fund LLC ' ELSE 'Person ' END, t.insider_id + 5000 + 1000 * s.slot)
    AS insider_name,
  t.txn_id % 3 = 0 AS is_officer, t.txn_id % 3 <> 1 AS is_director, t.txn_id % 3 = 1 AS is_ten_pct_owner,
  CASE WHEN t.txn_id % 3 = 0 THEN 'CEO' ELSE '' END AS officer_title,
  t.transaction_code, t.transaction_date,
  CASE WHEN t.txn_id % 29 = 0 THEN 0.0 ELSE t.shares END AS shares,
  CASE WHEN t.txn_id % 31 = 0 THEN NULL ELSE CAST(t.txn_id % 90 + 10 AS DOUBLE) END AS price_per_share,
  t.shares_owned_after, t.is_discretionary,
  CASE t.txn_id % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_common_stock
FROM fx_transactions t CROSS JOIN (VALUES (0), (1)) s(slot)
WHERE (s.slot = 0 OR t.txn_id % 10 = 0) AND t.txn_id % 19 <> 0"""


def _bulk(t):
    return bulk.quarter_transactions(R.raw_submissions(t), R.raw_owners(t), R.raw_trades(t),
                                     t.companies.where("company_id < 20"))


@query("s01_bulk_members", """
SELECT concat(' ', accession_number) AS accession,
  CASE txn_id % 6 WHEN 0 THEN concat('tab', chr(9), 'here') WHEN 1 THEN concat('two', chr(10), 'lines')
    WHEN 2 THEN 'pursuant to the "Plan"' WHEN 3 THEN 'a "quoted" word' WHEN 4 THEN '' ELSE 'plain' END AS remarks,
  CASE WHEN txn_id % 2 = 1 THEN 'x' END AS affirmed
FROM fx_transactions""")
def s01(t):
    """Member files with quoted tabs, line breaks and quotes, under two header versions, read as named text columns."""
    k = F.col("txn_id")
    remarks = (F.when(k % 6 == 0, F.lit('"tab\there"')).when(k % 6 == 1, F.lit('"two\nlines"'))
               .when(k % 6 == 2, F.lit('pursuant to the "Plan"')).when(k % 6 == 3, F.lit('"a ""quoted"" word"'))
               .when(k % 6 == 4, F.lit("")).otherwise(F.lit("plain")))
    accession = F.concat(F.lit(" "), "accession_number")
    newer = k % 2 == 1
    line = F.when(newer, F.concat_ws("\t", accession, F.lit("x"), remarks)).otherwise(
        F.concat_ws("\t", accession, remarks, F.lit("surplus")))
    header = F.when(F.col("newer"), "ACCESSION_NUMBER\tAFF10B5ONE\tREMARKS").otherwise("ACCESSION_NUMBER\tREMARKS")
    # A file holds the rows of a few hundred transactions.
    files = (t.transactions.select(F.floor(k / 500).alias("file"), newer.alias("newer"), line.alias("line"))
             .groupBy("file", "newer").agg(F.array_join(F.collect_list("line"), "\n").alias("body")))
    rows = bulk.members_from_texts(files.select(F.concat_ws("\n", header, "body").alias("text")), "SUBMISSION")
    return rows.select(F.col("ACCESSION_NUMBER").alias("accession"), F.col("REMARKS").alias("remarks"),
                       F.col("AFF10B5ONE").alias("affirmed"))


@query("s02_bulk_transactions", f"""
SELECT insider_cik, insider_name, is_officer, is_director, is_ten_pct_owner, officer_title, company_cik, company_ticker,
  concat(acc, '_', transaction_code, '_', transaction_date, '_', CAST(shares AS BIGINT), '.0') AS accession_number,
  filing_date, transaction_date, transaction_code, shares, price_per_share,
  CASE WHEN shares <> 0 AND price_per_share <> 0 THEN shares * price_per_share END AS total_value,
  shares_owned_after, is_discretionary, is_common_stock, is_10b5_1_plan
FROM ({_BULK_SQL}) WHERE CAST(company_cik AS INT) < 1020""")
def s02(t):
    return _bulk(t).drop("company_name", "acquired_or_disposed", "security_title")


@query("s03_form4_documents", """
SELECT CAST(CAST(concat(t.insider_id, s.suffix) AS INT) AS VARCHAR) AS insider_cik, concat('Person ', t.insider_id, s.suffix) AS insider_name,
  s.suffix = '1' AS is_officer, CAST(1000 + t.company_id AS VARCHAR) AS company_cik,
  concat(t.accession_number, '_', m.code, '_', t.transaction_date, '_',
         CASE m.code WHEN 'P' THEN CAST(t.shares AS BIGINT) ELSE 500 END, '.0') AS accession_number,
  t.filing_date, t.transaction_date, m.code AS transaction_code,
  CASE m.code WHEN 'P' THEN t.shares ELSE 500.0 END AS shares,
  CASE m.code WHEN 'P' THEN t.shares * 12.5 END AS total_value, m.code = 'P' AS is_discretionary,
  true AS is_common_stock, t.txn_id % 2 = 1 AS is_10b5_1_plan
FROM fx_transactions t CROSS JOIN (VALUES ('1'), ('2')) s(suffix) CROSS JOIN (VALUES ('P'), ('M')) m(code)""")
def s03(t):
    docs = documents.parse_form4_text(R.form4_docs(t), "xml")
    return documents.form4_transactions(docs).select(
        "insider_cik", "insider_name", "is_officer", "company_cik", "accession_number", "filing_date",
        "transaction_date", "transaction_code", "shares", "total_value", "is_discretionary", "is_common_stock",
        "is_10b5_1_plan")


@query("s04_submission_listing", """
SELECT company_id, concat(accession_number, s.suffix) AS accession_number, CAST(filing_date AS VARCHAR) AS filing_date,
       s.doc AS primary_document, s.form, '' AS report_date, s.items
FROM fx_transactions CROSS JOIN (VALUES ('', '4', 'doc.xml', ''), ('b', '8-K', '', '2.02')) s(suffix, form, doc, items)
WHERE filing_date >= DATE '1998-01-01'""")
def s04(t):
    return documents.listing_rows(R.listing_docs(t), "json", ["4", "8-K"], F.lit("1998-01-01").cast("date"))


@query("s05_company_facts", """
SELECT company_id, c.concept, period_end, filed_date, 'Q1' AS fiscal_period, '10-Q' AS form, round(value, 2) AS value
FROM fx_fundamentals CROSS JOIN (VALUES ('us-gaap:Revenues'), ('dei:EntityCommonStockSharesOutstanding')) c(concept)""")
def s05(t):
    return rounded(documents.company_facts(R.facts_docs(t), "json"), "value", digits=2)


@query("s06_short_volume_files", """
SELECT ticker, date, CAST(2 * short_volume AS BIGINT) AS short_volume, CAST(2 AS BIGINT) AS short_exempt_volume,
       CAST(2 * total_volume AS BIGINT) AS total_volume
FROM fx_short_volume WHERE ticker IN (SELECT ticker FROM fx_companies WHERE company_id < 20)""")
def s06(t):
    return documents.short_volume_rows(R.short_volume_lines(t), t.companies.where("company_id < 20"))


@query("s07_filing_events", "SELECT accession_number, company_id, form_type, filing_date, report_date, items FROM ox_filing_events")
def s07(t):
    return R.filing_events(t)


@query("s08_earnings_days", """
SELECT company_id, earnings_date, report_time FROM (
  SELECT CAST(event_id % 25 AS INT) AS company_id, CAST(ts AS DATE) AS earnings_date,
    CASE WHEN event_id % 5 = 0 OR hour(ts) = 0 THEN NULL WHEN hour(ts) < 12 THEN 'BMO' ELSE 'AMC' END AS report_time,
    row_number() OVER (PARTITION BY event_id % 25, CAST(ts AS DATE) ORDER BY event_id) AS pick FROM events)
WHERE pick = 1""")
def s08(t):
    stamps = t.base("events").select(
        (F.col("event_id") % 25).cast("int").alias("company_id"), "event_id",
        F.when(F.col("event_id") % 5 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts")).alias("ts"))
    return documents.earnings_days(stamps, order="event_id")


@query("s09_derivative_rows", """
SELECT accession_number, txn_id AS deriv_trans_sk, transaction_date AS trans_date,
  CAST(txn_id % 50 AS DOUBLE) AS conv_exercise_price, shares AS trans_shares, filing_date AS exercisable_date,
  CASE WHEN txn_id % 2 = 1 THEN filing_date END AS expiration_date, 'E' AS timeliness
FROM fx_transactions WHERE txn_id % 37 <> 0""")
def s09(t):
    return bulk.derivative_rows(R.raw_derivatives(t)).select(
        "accession_number", "deriv_trans_sk", "trans_date", "conv_exercise_price", "trans_shares",
        "exercisable_date", "expiration_date", "timeliness")


@query("s10_filing_meta", """
SELECT accession_number, CASE WHEN txn_id % 23 <> 0 THEN filing_date END AS filing_date,
  CASE WHEN txn_id % 3 <> 0 THEN transaction_date END AS period_of_report,
  CASE WHEN txn_id % 4 = 0 THEN 'note' END AS remarks, 'bulk_tsv' AS source FROM fx_transactions""")
def s10(t):
    return bulk.filing_meta(R.raw_submissions(t))


@query("s11_details_to_load", """
SELECT f.accession_number, f.footnote_id, trim(f.text, ' ') AS text FROM fx_footnotes f
WHERE EXISTS (SELECT 1 FROM fx_transactions t WHERE t.accession_number = f.accession_number AND t.txn_id % 7 <> 0)""")
def s11(t):
    keyed = t.transactions.withColumn("accession_number", S.transaction_key(
        "accession_number", "transaction_code", "transaction_date", "shares"))
    loaded = t.transactions.where("txn_id % 7 = 0").select("accession_number")
    return loading.details_to_load(bulk.footnote_rows(R.raw_footnotes(t)), keyed, loaded)


@query("s12_upsert_absent", """
SELECT insider_id, company_id, transaction_date, txn_id, total_value FROM (
  SELECT *, row_number() OVER (PARTITION BY insider_id, company_id, transaction_date ORDER BY txn_id) AS pick
  FROM fx_transactions WHERE transaction_date >= DATE '1997-01-01') i
WHERE pick = 1 AND NOT EXISTS (SELECT 1 FROM fx_transactions e WHERE e.transaction_date < DATE '1998-01-01'
  AND e.insider_id = i.insider_id AND e.company_id = i.company_id AND e.transaction_date = i.transaction_date)""")
def s12(t):
    keys = ["insider_id", "company_id", "transaction_date"]
    rows = t.transactions.select(*keys, "txn_id", "total_value")
    return loading.upsert_absent(rows.where("transaction_date < DATE'1998-01-01'"),
                                 rows.where("transaction_date >= DATE'1997-01-01'"), keys, order="txn_id")


@query("s13_insider_dimension", f"""
SELECT insider_cik AS cik, arg_min(insider_name, k) AS name,
       regexp_matches(arg_min(insider_name, k), '\\bLLC\\b') AS is_institution
FROM ({_BULK_SQL}) WHERE CAST(company_cik AS INT) < 1020 GROUP BY insider_cik""")
def s13_insiders(t):
    rows = _bulk(t).withColumn("seq", F.substring_index(F.substring("accession_number", 2, 30), "_", 1).cast("bigint"))
    return loading.insider_dimension(rows, order="seq").drop("insider_id")


@query("s13_company_dimension", f"""
SELECT company_cik AS cik, arg_min(company_ticker, k) AS ticker, arg_min(company_name, k) AS name, 1 AS ids, true AS steady
FROM ({_BULK_SQL}) WHERE CAST(company_cik AS INT) < 1020 GROUP BY company_cik""")
def s13_companies(t):
    """One id per company, the same whatever rows came first."""
    rows = _bulk(t).withColumn("seq", F.substring_index(F.substring("accession_number", 2, 30), "_", 1).cast("bigint"))
    one = loading.company_dimension(rows, order="seq")
    other = loading.company_dimension(rows.withColumn("seq", -F.col("seq")), order="seq")
    both = one.join(other.select("cik", F.col("company_id").alias("other_id")), "cik")
    ids = one.groupBy("company_id").agg(F.count(F.lit(1)).cast("int").alias("ids"))
    return both.join(ids, "company_id").select("cik", "ticker", "name", "ids", (F.col("company_id") == F.col("other_id")).alias("steady"))


@query("s13_role_dimension", f"""
SELECT insider_cik, company_cik, CASE arg_min(k, k) % 3 WHEN 0 THEN 'CEO' WHEN 1 THEN '10% Owner' ELSE 'Director' END
  AS role_title, arg_min(is_officer, k) AS is_officer, arg_min(is_director, k) AS is_director,
  max(CASE WHEN first_k = k THEN filing_date END) AS first_filing_date, max(filing_date) AS last_filing_date
FROM (SELECT *, min(k) OVER (PARTITION BY insider_cik, company_cik) AS first_k FROM ({_BULK_SQL})
      WHERE CAST(company_cik AS INT) < 1020)
GROUP BY insider_cik, company_cik""")
def s13_roles(t):
    rows = _bulk(t).withColumn("seq", F.substring_index(F.substring("accession_number", 2, 30), "_", 1).cast("bigint"))
    return loading.role_dimension(rows, order="seq").drop("is_ten_percent_owner")


@query("s14_plan_flag_fill", """
SELECT txn_id, coalesce(is_10b5_1_plan, CASE txn_id % 5 WHEN 0 THEN true WHEN 2 THEN false WHEN 3 THEN true
  WHEN 4 THEN false END) AS is_10b5_1_plan
FROM (SELECT txn_id, CASE WHEN txn_id % 2 = 0 THEN is_10b5_1_plan END AS is_10b5_1_plan FROM fx_transactions)""")
def s14(t):
    rows = t.transactions.select(
        "txn_id", F.concat("accession_number", F.lit("_P")).alias("accession_number"),
        F.when(F.col("txn_id") % 2 == 0, F.col("is_10b5_1_plan")).alias("is_10b5_1_plan"))
    filed = F.coalesce(S.day_month_year("FILING_DATE"), F.lit("1900-01-01").cast("date"))
    return loading.fill_plan_flags(rows, R.raw_submissions(t), order=filed).select("txn_id", "is_10b5_1_plan")


@query("s15_fill_sectors", """
SELECT ticker, CASE WHEN company_id % 2 = 0 THEN sector WHEN company_id % 3 = 0 THEN 'Utilities' END AS sector
FROM fx_companies""")
def s15(t):
    gaps = t.companies.select("company_id", "ticker", F.when(F.col("company_id") % 2 == 0, F.col("sector")).alias("sector"),
                              F.lit(None).cast("string").alias("industry"))
    lookup = t.companies.where("company_id % 3 = 0").select("ticker", F.lit("Utilities").alias("sector"),
                                                            F.lit("Power").alias("industry"))
    return loading.fill_sectors(gaps, lookup).select("ticker", "sector")


@query("s16_universe_filter", """
SELECT t.txn_id, c.ticker FROM fx_transactions t JOIN fx_companies c USING (company_id) WHERE c.company_id % 4 <> 0""")
def s16(t):
    k = F.col("company_id")
    lines = t.companies.select(F.explode(F.array(
        F.when(k % 4 == 0, F.concat(F.lit("# "), "ticker")).otherwise(F.concat(F.lit(" "), F.lower("ticker"))),
        F.lit(""), F.lit("# comment"))).alias("value"))
    rows = t.transactions.join(t.companies.select("company_id", "ticker"), "company_id")
    return rows.join(documents.universe_tickers(lines), "ticker", "left_semi").select("txn_id", "ticker")


@query("s17_missing_coverage", """
SELECT ticker, start_date, end_date, stored_days, expected_days FROM (
  SELECT r.*, (SELECT count(DISTINCT p.date) FROM fx_prices p WHERE p.ticker = r.ticker
               AND p.date BETWEEN r.start_date AND r.end_date) AS stored_days,
         greatest(1, CAST(floor((end_date - start_date) * 5 / 7) AS BIGINT)) AS expected_days
  FROM (SELECT DISTINCT c.ticker, t.transaction_date AS start_date, t.transaction_date + 60 AS end_date
        FROM fx_transactions t JOIN fx_companies c USING (company_id)) r) WHERE stored_days < expected_days - 2""")
def s17(t):
    ranges = t.transactions.join(t.companies, "company_id").select(
        "ticker", F.col("transaction_date").alias("start_date"),
        F.date_add("transaction_date", 60).alias("end_date")).distinct()
    return P.missing_coverage(t.prices, ranges)


@query("s18_loaded_tickers", """
SELECT ticker, EXISTS (SELECT 1 FROM fx_transactions t WHERE t.company_id = c.company_id AND t.txn_id % 25 < 3) AS loaded
FROM fx_companies c""")
def s18(t):
    return loading.loaded_tickers(t.companies, t.transactions.where("txn_id % 25 < 3"))


@query("s20_analysis_frame", """
SELECT l.txn_id, l.ticker, l.transaction_date, r.role_title, s.tier, round(s.skill_score, 6) AS skill_score,
       round(l.excess_return_60d, 6) AS excess_return_60d,
       EXISTS (SELECT 1 FROM fx_transactions x WHERE x.transaction_code IN ('S', 'F') AND x.insider_id = l.insider_id
               AND x.company_id = l.company_id AND x.transaction_date = l.transaction_date) AS has_same_day_sell
FROM ox_buys l LEFT JOIN fx_roles r USING (insider_id, company_id) LEFT JOIN ox_scores s USING (insider_id)""")
def s20(t):
    from insidertrail.operators import events as E
    from insidertrail.plans.helpers import buy_events

    rows = E.mark_same_day_sells(E.with_role_title(buy_events(t), t.roles), E.same_day_sells(t.transactions))
    rows = rows.join(scores(t).select("insider_id", "tier", "skill_score"), "insider_id", "left")
    return rounded(rows.select("txn_id", "ticker", "transaction_date", "role_title", "tier", "skill_score",
                               "excess_return_60d", "has_same_day_sell"), "skill_score", "excess_return_60d")


# --- scalar functions -------------------------------------------------------


@query("f01_bulk_dates", """
SELECT txn_id, CASE WHEN txn_id % 23 <> 0 THEN filing_date END AS d FROM fx_transactions""")
def f01(t):
    raw = t.transactions.select("txn_id", F.when(F.col("txn_id") % 23 == 0, F.lit("31-FOO-2020")).otherwise(
        F.upper(F.date_format("filing_date", " d-MMM-yyyy "))).alias("x"))
    return raw.select("txn_id", S.day_month_year("x").alias("d"))


@query("f02_iso_dates", """
SELECT txn_id, CASE WHEN txn_id % 9 <> 0 THEN filing_date END AS d FROM fx_transactions""")
def f02(t):
    raw = t.transactions.select("txn_id", F.when(F.col("txn_id") % 9 == 0, F.lit("2020-13-01")).otherwise(
        F.concat(F.lit(" "), F.col("filing_date").cast("string"))).alias("x"))
    return raw.select("txn_id", S.iso_date("x").alias("d"))


@query("f03_safe_double", """
SELECT txn_id, CASE txn_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 1500.0
  ELSE total_value END AS v FROM fx_transactions""")
def f03(t):
    k = F.col("txn_id") % 6
    raw = t.transactions.select("txn_id", F.when(k == 0, "").when(k == 1, "abc").when(k == 2, "12d").when(
        k == 3, "1.5e3").otherwise(F.concat(F.lit(" "), F.col("total_value").cast("string"))).alias("x"))
    return raw.select("txn_id", S.safe_double("x").alias("v"))


@query("f04_relationships", """
SELECT txn_id, txn_id % 4 IN (0, 3) AS is_officer, txn_id % 4 IN (0, 1) AS is_director, txn_id % 4 = 3 AS is_ten_pct_owner
FROM fx_transactions""")
def f04(t):
    k = F.col("txn_id") % 4
    raw = t.transactions.select("txn_id", F.when(k == 0, "Director, OFFICER").when(k == 1, "director").when(
        k == 3, "TenPercentOwner,Officer").alias("x"))
    return raw.select("txn_id", *[c.alias(n) for n, c in S.relationship_flags("x").items()])


@query("f05_cik_keys", """
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS bare, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded,
       c_custkey % 3 <> 0 AS plausible FROM customer""")
def f05(t):
    raw = t.base("customer").withColumn("x", F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    odd = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("10000001"), "x")).otherwise(F.col("x"))
    return raw.select("c_custkey", S.strip_cik("x").alias("bare"), S.pad_cik("c_custkey").alias("padded"),
                      S.is_plausible_cik(odd).alias("plausible"))


@query("f06_common_stock", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS common
FROM part""")
def f06(t):
    k = F.col("p_partkey") % 5
    title = F.when(k == 1, F.concat("p_name", F.lit(" Preferred Stock"))).when(k == 2, "Membership").when(
        k == 3, "Class A COMMON STOCK").when(k == 4, "Ordinary Shares")
    return t.base("part").select("p_partkey", S.is_common_stock(title).alias("common"))


@query("f07_plan_flag", """
SELECT txn_id, CASE txn_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL END AS plan
FROM fx_transactions""")
def f07(t):
    k = F.col("txn_id") % 5
    return t.transactions.select("txn_id", S.plan_flag(
        F.when(k == 0, " True").when(k == 1, "1").when(k == 2, "0").when(k == 3, "maybe")).alias("plan"))


@query("f08_discretionary", "SELECT txn_id, transaction_code = 'P' AS discretionary FROM fx_transactions")
def f08(t):
    return t.transactions.select("txn_id", S.is_discretionary("transaction_code").alias("discretionary"))


@query("f09_institution_names", """
SELECT c_custkey, c_custkey % 6 IN (0, 1, 5) AS institution FROM customer""")
def f09(t):
    k = F.col("c_custkey") % 6
    name = F.concat("c_name", F.when(k == 0, " Capital").when(k == 1, " l.p. x").when(k == 2, " Foo & Co").when(
        k == 3, " Trusty").when(k == 4, " Smith").otherwise(" foo& co"))
    return t.base("customer").select("c_custkey", S.is_institution(name).alias("institution"))


@query("f10_senior_titles", """
SELECT insider_id, company_id, role_title IN ('Chief Executive Officer', 'CFO') AS csuite,
       role_title = 'Chief Executive Officer' AS ceo, role_title = 'CFO' AS cfo FROM fx_roles""")
def f10(t):
    return t.roles.select("insider_id", "company_id", S.is_csuite("role_title").alias("csuite"),
                          S.is_ceo("role_title").alias("ceo"), S.is_cfo("role_title").alias("cfo"))


@query("f11_role_weight", """
SELECT insider_id, company_id, CASE role_title WHEN 'Chief Executive Officer' THEN 1.0::DOUBLE WHEN 'CFO' THEN 0.95
  WHEN 'Director' THEN 0.6 WHEN 'Senior Vice President' THEN 0.9 ELSE 0.5 END AS weight FROM fx_roles""")
def f11(t):
    return t.roles.select("insider_id", "company_id", S.role_weight("role_title").alias("weight"))


@query("f12_total_value", """
SELECT txn_id, round(CASE WHEN txn_id % 4 = 0 THEN NULL ELSE shares * price_per_share END, 4) AS v FROM fx_transactions""")
def f12(t):
    k = F.col("txn_id")
    shares = F.when(k % 8 == 0, 0.0).otherwise(F.col("shares"))
    price = F.when(k % 8 == 4, F.lit(None)).otherwise(F.col("price_per_share"))
    return t.transactions.select("txn_id", F.round(S.total_value(shares, price), 4).alias("v"))


@query("f13_transaction_key", """
SELECT txn_id, concat(accession_number, '_', transaction_code, '_', transaction_date, '_',
  CASE txn_id % 4 WHEN 0 THEN concat(CAST(CAST(shares * 100000 AS BIGINT) AS VARCHAR), '.0')
    WHEN 1 THEN concat(CAST(CAST(shares AS BIGINT) AS VARCHAR), '.25')
    WHEN 2 THEN concat(CAST(CAST(shares AS BIGINT) * 100000 AS VARCHAR), '.1234') ELSE '1e-07' END) AS key,
  accession_number AS raw
FROM fx_transactions""")
def f13(t):
    shares, turn = F.col("shares"), F.col("txn_id") % 4
    sh = (F.when(turn == 0, shares * 100000).when(turn == 1, shares + 0.25)
          .when(turn == 2, shares * 100000 + 0.1234).otherwise(F.lit(1e-7)))
    key = S.transaction_key("accession_number", "transaction_code", "transaction_date", sh)
    return t.transactions.select("txn_id", key.alias("key"), S.raw_accession(key).alias("raw"))


@query("f14_returns", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount - 1 END, 6)
  AS ret FROM lineitem""")
def f14(t):
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(
        S.simple_return(F.col("l_discount"), F.col("l_tax")), 6).alias("ret"))


@query("f15_footnote_classes", """
SELECT accession_number, plan AND NOT neg AS is_plan, neg AS plan_negated,
  CASE WHEN plan AND NOT neg THEN nullif(regexp_extract(text,
    '(?:adopted|entered\\s+into|dated)\\s+(?:on\\s+|as\\s+of\\s+)?([A-Z][a-z]+\\s+\\d{1,2},?\\s+\\d{4})', 1), '') END
    AS plan_adoption_date,
  concat_ws(',', CASE WHEN regexp_matches(text, '(?i)dividend\\s+reinvestment') THEN 'drip' END,
    CASE WHEN regexp_matches(text, '(?i)401\\s*\\(\\s*k\\s*\\)') THEN 'retirement_401k' END,
    CASE WHEN regexp_matches(text, '(?i)employee\\s+stock\\s+purchase\\s+plan|\\bESPP\\b') THEN 'espp' END,
    CASE WHEN regexp_matches(text, '(?i)deferred\\s+compensation') THEN 'deferred_comp' END) AS mechanical_kinds
FROM (SELECT *, plan0 AS plan, plan0 AND regexp_matches(text,
  '(?i)(?:not|other\\s+than)[^.]{0,80}?(?:pursuant\\s+to|under)[^.]{0,40}?10b5-?1') AS neg
  FROM (SELECT *, regexp_matches(text, '(?i)10b5-?1') AS plan0 FROM fx_footnotes))""")
def f15(t):
    from insidertrail.operators.footnotes import with_classes

    return with_classes(t.footnotes).select(
        "accession_number", "is_plan", "plan_negated", "plan_adoption_date",
        F.concat_ws(",", "mechanical_kinds").alias("mechanical_kinds"))


@query("f16_filing_lag", """
SELECT txn_id, CAST(greatest(filing_date - 3 - transaction_date, 0) AS BIGINT) AS lag_days,
  CASE WHEN filing_date - 3 - transaction_date <= 0 THEN 'same_day' WHEN filing_date - 3 - transaction_date <= 2 THEN 'fast'
       WHEN filing_date - 3 - transaction_date <= 5 THEN 'normal' ELSE 'slow' END AS bucket FROM fx_transactions""")
def f16(t):
    lag = S.filing_lag_days("transaction_date", F.date_sub("filing_date", 3))
    return t.transactions.select("txn_id", lag.cast("bigint").alias("lag_days"), S.filing_lag_bucket(lag).alias("bucket"))


@query("f17_severity", """
SELECT c_custkey, CASE WHEN r <= -0.4 THEN 'crash' WHEN r <= -0.25 THEN 'severe' WHEN r <= -0.15 THEN 'moderate_dd'
  WHEN r <= -0.05 THEN 'moderate_dip' WHEN r <= 0.1 THEN 'neutral' ELSE 'strength' END AS severity
FROM (SELECT c_custkey, c_acctbal / 10000.0 - 0.5 AS r FROM customer)""")
def f17(t):
    return t.base("customer").select("c_custkey", S.drawdown_severity(F.col("c_acctbal") / 10000.0 - 0.5).alias("severity"))


@query("f18_sector_funds", """
SELECT company_id, CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Energy' THEN 'XLE' END AS outcome_fund,
  CASE sector WHEN 'Technology' THEN 'XLK' WHEN 'Energy' THEN 'XLE' ELSE 'XLF' END AS profile_fund FROM fx_companies""")
def f18(t):
    return t.companies.select("company_id", S.sector_fund("sector").alias("outcome_fund"),
                              S.sector_fund("sector", S.PROFILE_SECTOR_FUNDS).alias("profile_fund"))


@query("f19_ticker_format", """
SELECT page_id, regexp_matches(upper(trim(url)), '^[A-Z0-9.\\-]{1,10}$') AS url_ok, true AS short_ok FROM pages""")
def f19(t):
    return t.base("pages").select("page_id", S.is_ticker("url").alias("url_ok"),
                                  S.is_ticker(F.concat(F.lit(" br."), F.col("page_id") % 10)).alias("short_ok"))


@query("f20_exit_target", """
SELECT txn_id, (SELECT max(d) FROM (SELECT d FROM (
   SELECT unnest(generate_series(CAST(filing_date AS TIMESTAMP) + INTERVAL 1 DAY,
                                 CAST(filing_date AS TIMESTAMP) + INTERVAL 100 DAY, INTERVAL 1 DAY))::DATE AS d)
   WHERE isodow(d) < 6 ORDER BY d LIMIT 60)) AS exit_target FROM fx_transactions""")
def f20(t):
    return t.transactions.select("txn_id", S.plus_weekdays("filing_date", 60).alias("exit_target"))


@query("f21_value_bounds", "SELECT txn_id, total_value BETWEEN 500 AND 10000000000 AS ok FROM fx_transactions")
def f21(t):
    return t.transactions.select("txn_id", S.value_in_bounds("total_value").alias("ok"))


@query("f22_atoms", """
SELECT txn_id, cluster_size >= 2 AS cluster_2plus, role_title IN ('Chief Executive Officer', 'CFO') AS senior_role,
  total_value >= 100000 AS value_100k, NOT coalesce(is_10b5_1_plan, false) AS not_10b5_1, NOT is_routine AS opportunistic,
  is_first_buy AS first_buy, cluster_size >= 2 AND total_value >= 100000 AND NOT coalesce(is_10b5_1_plan, false) AS combo
FROM ox_flagged""")
def f22(t):
    from insidertrail.plans.helpers import flagged

    return flagged(t).select("txn_id", *[build().alias(n) for n, build in S.ATOMS.items()],
                             S.all_atoms(["cluster_2plus", "value_100k", "not_10b5_1"]).alias("combo"))


@query("f23_role_category", """
SELECT insider_id, company_id, CASE WHEN is_officer THEN 'officer' WHEN is_director THEN 'director' ELSE '10pct_owner' END
  AS category FROM fx_roles""")
def f23(t):
    return t.roles.select("insider_id", "company_id", S.role_category("is_officer", "is_director").alias("category"))
