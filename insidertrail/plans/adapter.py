"""Views of the test tables in the shape of filings, prices and filing events.

``tables(spark, sf_dir)`` gives DataFrames; ``with_views(sql)`` prepends the same
definitions as CTEs so that another SQL engine computes from the base tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.session import shared_folder

VIEW_SQL = {
    "fx_transactions": """
SELECT o_orderkey AS txn_id,
       CAST(o_custkey % 300 AS INT) AS insider_id,
       CAST((o_custkey + o_orderkey % 2) % 25 AS INT) AS company_id,
       concat('A', CAST(o_orderkey AS STRING)) AS accession_number,
       CAST(date_trunc('week', o_orderdate) AS DATE) AS transaction_date,
       CAST(date_trunc('week', o_orderdate) AS DATE) + CAST(o_orderkey % 8 AS INT) AS filing_date,
       CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'P' END AS transaction_code,
       CAST(100 + o_orderkey % 900 AS DOUBLE) AS shares,
       o_totalprice / (100 + o_orderkey % 900) AS price_per_share,
       o_totalprice AS total_value,
       CAST(1000 + o_orderkey % 5000 AS DOUBLE) AS shares_owned_after,
       o_orderstatus <> 'P' AS is_discretionary,
       CASE o_orderkey % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS is_common_stock,
       CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_10b5_1_plan
FROM orders""",
    "fx_insiders": """
SELECT DISTINCT insider_id, concat('Insider ', CAST(insider_id AS STRING)) AS name,
       insider_id % 17 = 0 AS is_institution FROM fx_transactions""",
    "fx_roles": """
SELECT insider_id, company_id,
       CASE (insider_id * 7 + company_id) % 5 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'CFO'
            WHEN 2 THEN 'Director' WHEN 3 THEN 'Senior Vice President' ELSE '10% Owner' END AS role_title,
       (insider_id * 7 + company_id) % 5 IN (0, 1, 3) AS is_officer,
       (insider_id * 7 + company_id) % 5 = 2 AS is_director,
       min(filing_date) - CAST((insider_id % 4) * 365 AS INT) AS first_filing_date,
       max(filing_date) AS last_filing_date
FROM fx_transactions GROUP BY insider_id, company_id""",
    "fx_companies": """
SELECT DISTINCT company_id, concat('T', CAST(company_id AS STRING)) AS ticker,
       CASE company_id % 3 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Energy' ELSE 'Financial Services' END AS sector
FROM fx_transactions""",
    "fx_prices": """
SELECT concat('T', CAST(l_partkey % 25 AS STRING)) AS ticker, CAST(l_shipdate AS DATE) AS date,
       50 + avg(l_quantity) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume
FROM lineitem GROUP BY l_partkey % 25, CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'SPY', CAST(l_shipdate AS DATE), 50 + avg(l_quantity), CAST(sum(l_quantity) AS BIGINT)
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT CASE l_partkey % 25 % 3 WHEN 0 THEN 'XLK' WHEN 1 THEN 'XLE' ELSE 'XLF' END, CAST(l_shipdate AS DATE),
       50 + avg(l_quantity), CAST(sum(l_quantity) AS BIGINT)
FROM lineitem GROUP BY l_partkey % 25 % 3, CAST(l_shipdate AS DATE)""",
    "fx_earnings": """
SELECT ticker, min(date) AS earnings_date FROM fx_prices WHERE ticker LIKE 'T%'
GROUP BY ticker, date_trunc('quarter', date)""",
    "fx_fundamentals": """
SELECT company_id, 'us-gaap:Revenues' AS concept,
       CAST(date_trunc('quarter', transaction_date) AS DATE) AS period_end,
       CAST(date_trunc('quarter', transaction_date) AS DATE) + 45 AS filed_date, sum(total_value) AS value
FROM fx_transactions GROUP BY company_id, date_trunc('quarter', transaction_date)""",
    "fx_footnotes": """
SELECT concat('A', CAST(doc_id AS STRING)) AS accession_number, 'F1' AS footnote_id,
       concat(text, CASE doc_id % 6
         WHEN 0 THEN ' effected pursuant to a Rule 10b5-1 trading plan adopted on March 15, 2019.'
         WHEN 1 THEN ' was not made pursuant to a Rule 10b5-1 trading plan.'
         WHEN 2 THEN ' acquired under the dividend reinvestment plan.'
         WHEN 3 THEN ' held in the 401(k) account.'
         WHEN 4 THEN ' Purchased under the Employee Stock Purchase Plan.'
         ELSE ' held through a family trust.' END) AS text
FROM documents""",
    "fx_short_volume": """
SELECT concat('T', CAST(user_id % 25 AS STRING)) AS ticker, CAST(ts AS DATE) AS date,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS short_volume, count(*) AS total_volume
FROM events GROUP BY user_id % 25, CAST(ts AS DATE)""",
    "fx_filing_stream": """
SELECT event_id AS accession_id, ts AS filed_at, CAST(user_id AS INT) AS insider_id,
       CAST(event_id % 25 AS INT) AS company_id,
       CASE WHEN event_type = 'purchase' THEN 'P' ELSE 'S' END AS transaction_code, value AS total_value
FROM events""",
    "fx_positions": """
SELECT txn_id AS position_id, txn_id AS alert_id, txn_id AS entry_order_id, insider_id,
       concat('T', CAST(company_id AS STRING)) AS symbol,
       CASE WHEN txn_id % 9 = 0 THEN 0.0 ELSE shares END AS shares, price_per_share AS entry_price,
       filing_date AS entry_date, filing_date + 84 AS exit_target_date,
       CASE txn_id % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'closing' WHEN 2 THEN 'delisted' WHEN 3 THEN 'open'
            ELSE 'closed' END AS status,
       CASE WHEN txn_id % 6 IN (2, 4, 5) THEN filing_date + 80 END AS exit_date,
       CASE WHEN txn_id % 6 = 4 THEN 'orphan_no_sell' WHEN txn_id % 6 = 5 THEN 'sold' END AS close_reason,
       txn_id % 11 = 0 AS reconcile_hold
FROM fx_transactions WHERE transaction_code = 'P'""",
    "fx_orders": """
SELECT txn_id AS order_id, txn_id AS alert_id, concat('T', CAST(company_id AS STRING)) AS symbol, 'buy' AS side,
       CASE WHEN txn_id % 4 = 0 THEN NULL ELSE total_value END AS notional, filing_date AS created_on
FROM fx_transactions WHERE transaction_code = 'P'""",
}

# Stage tables this process has finished writing.
_WRITTEN: set[str] = set()

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def ordered_ctes(sql: str, definitions: dict[str, str]) -> list[str]:
    """Names of the definitions a query needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in definitions:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(definitions[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    definitions = {**VIEW_SQL, **(extra or {})}
    names = ordered_ctes(sql, definitions)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({definitions[n].strip()})" for n in names)
    return f"WITH {ctes}\n{sql.strip()}"


class Tables:
    """Lazily built adapter DataFrames over one data directory.

    Results that later steps build on (outcomes, scores, flagged buys, trades)
    are written once per application as tables in the shared folder and read
    back from there, as a pipeline of jobs would; a lost executor then costs
    one stage and not the whole lineage.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        app = self.spark.sparkContext.applicationId
        source = re.sub(r"[^A-Za-z0-9.]+", "-", self.sf_dir).strip("-")
        path = f"{shared_folder(self.spark)}/insidertrail/{app}/{source}/{name}"
        if path not in _WRITTEN:
            build().write.mode("overwrite").parquet(path)
            _WRITTEN.add(path)
        return self.spark.read.parquet(path)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str, **inputs: DataFrame) -> DataFrame:
        body = VIEW_SQL[name]
        for table in inputs:
            body = re.sub(rf"\b{table}\b", "{" + table + "}", body)
        return self.spark.sql(body, **inputs)

    @cached_property
    def transactions(self) -> DataFrame:
        return self._sql("fx_transactions", orders=self.base("orders"))

    @cached_property
    def insiders(self) -> DataFrame:
        return self._sql("fx_insiders", fx_transactions=self.transactions)

    @cached_property
    def roles(self) -> DataFrame:
        return self._sql("fx_roles", fx_transactions=self.transactions)

    @cached_property
    def companies(self) -> DataFrame:
        return self._sql("fx_companies", fx_transactions=self.transactions)

    @cached_property
    def prices(self) -> DataFrame:
        """The three price groups from one aggregation of lineitem.

        Quantities are whole numbers, so re-adding daily sums is exact.
        """
        k = F.col("k")
        fund = F.when(k % 3 == 0, "XLK").when(k % 3 == 1, "XLE").otherwise("XLF")
        daily = (self.base("lineitem")
                 .groupBy((F.col("l_partkey") % 25).alias("k"), F.col("l_shipdate").cast("date").alias("date"))
                 .agg(F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("n")))
        return (daily.select("date", "q", "n", F.explode(F.array(
                    F.concat(F.lit("T"), k.cast("string")), F.lit("SPY"), fund)).alias("ticker"))
                .groupBy("ticker", "date")
                .agg((50 + F.sum("q") / F.sum("n")).alias("adj_close"), F.sum("q").cast("bigint").alias("volume")))

    @cached_property
    def earnings(self) -> DataFrame:
        return self._sql("fx_earnings", fx_prices=self.prices)

    @cached_property
    def fundamentals(self) -> DataFrame:
        return self._sql("fx_fundamentals", fx_transactions=self.transactions)

    @cached_property
    def footnotes(self) -> DataFrame:
        return self._sql("fx_footnotes", documents=self.base("documents"))

    @cached_property
    def short_volume(self) -> DataFrame:
        return self._sql("fx_short_volume", events=self.base("events"))

    @cached_property
    def positions(self) -> DataFrame:
        return self._sql("fx_positions", fx_transactions=self.transactions)

    @cached_property
    def orders(self) -> DataFrame:
        return self._sql("fx_orders", fx_transactions=self.transactions)

    @cached_property
    def filing_stream(self) -> DataFrame:
        return self._sql("fx_filing_stream", events=self.base("events"))
