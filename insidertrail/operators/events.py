"""Buy events: loading, lot collapse and the joins that start every analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_KEY = ["insider_id", "company_id", "transaction_date"]
OUTCOME_COLUMNS = [
    "excess_return_20d", "excess_return_60d", "excess_return_120d",
    "hit_20d", "hit_60d", "hit_120d", "prior_momentum_20d",
    "stock_return_20d", "stock_return_60d", "stock_return_120d",
]


def common_or_unknown(col: str = "is_common_stock") -> Column:
    return F.coalesce(F.col(col), F.lit(True))


def person_buys(transactions: DataFrame, insiders: DataFrame) -> DataFrame:
    """Discretionary common-stock buys by people."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    return (transactions.where(F.col("is_discretionary") & common_or_unknown())
            .join(people, "insider_id", "left_semi"))


def matured_buys(transactions: DataFrame, outcomes: DataFrame, companies: DataFrame,
                 insiders: DataFrame) -> DataFrame:
    """Person buys with their outcome, ticker and names (one row per lot)."""
    people = (insiders.where(~F.col("is_institution"))
              .select("insider_id", F.col("name").alias("insider_name"), "is_institution"))
    firms = companies.select("company_id", "ticker")
    return (transactions.where(F.col("is_discretionary") & common_or_unknown())
            .join(outcomes.select("txn_id", *OUTCOME_COLUMNS), "txn_id")
            .join(firms, "company_id").join(people, "insider_id"))


def collapse_lots(buys: DataFrame) -> DataFrame:
    """One row per (insider, company, trade date).

    Shares and values add up; every other column is the first non-NULL value in
    lot order, ``shares_owned_after`` the last.  Sums of only NULLs are zero.
    """
    def first(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("txn_id"))).alias(name)

    def last(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("txn_id"))).alias(name)

    summed = {"shares", "total_value"}
    aggs = []
    for name in buys.columns:
        if name in EVENT_KEY:
            continue
        if name == "txn_id":
            aggs.append(F.min(name).alias(name))
        elif name in summed:
            aggs.append(F.coalesce(F.sum(name), F.lit(0.0)).alias(name))
        elif name == "shares_owned_after":
            aggs.append(last(name))
        else:
            aggs.append(first(name))
    keyed = buys.where(" AND ".join(f"{k} IS NOT NULL" for k in EVENT_KEY))
    return keyed.groupBy(*EVENT_KEY).agg(*aggs)


def largest_lots(transactions: DataFrame) -> DataFrame:
    """Largest lot of each event (ties: first id) with the event's summed value."""
    value = F.coalesce(F.col("total_value"), F.lit(0.0))
    rest = [c for c in transactions.columns if c not in EVENT_KEY]
    best = F.max_by(F.struct(*rest), F.struct(value, -F.col("txn_id")))
    return (transactions.groupBy(*EVENT_KEY)
            .agg(best.alias("_lot"), F.sum(value).alias("event_total_value"))
            .select(*EVENT_KEY, "_lot.*", "event_total_value"))


def first_outcome_per_day(outcomes: DataFrame) -> DataFrame:
    """One outcome per (insider, trade date), the earliest id kept."""
    rest = [c for c in outcomes.columns if c not in ("insider_id", "transaction_date")]
    return (outcomes.groupBy("insider_id", "transaction_date")
            .agg(F.min_by(F.struct(*rest), "txn_id").alias("_first"))
            .select("insider_id", "transaction_date", "_first.*"))


def with_role_title(buys: DataFrame, roles: DataFrame) -> DataFrame:
    """Role title by (insider, company); a repeated role key keeps its smallest title."""
    one = roles.groupBy("insider_id", "company_id").agg(F.min("role_title").alias("role_title"))
    return buys.join(one, ["insider_id", "company_id"], "left")


def without_matches(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Pending work: rows that have no match yet."""
    return rows.join(done.select(*on).distinct(), on, "left_anti")


def same_day_sells(transactions: DataFrame, codes: tuple[str, ...] = ("S", "F")) -> DataFrame:
    return transactions.where(F.col("transaction_code").isin(*codes)).select(*EVENT_KEY).distinct()


def mark_same_day_sells(buys: DataFrame, sells: DataFrame) -> DataFrame:
    return (buys.join(sells.withColumn("has_same_day_sell", F.lit(True)), EVENT_KEY, "left")
            .withColumn("has_same_day_sell", F.coalesce("has_same_day_sell", F.lit(False))))


def csuite_sell_days(transactions: DataFrame, companies: DataFrame, roles: DataFrame) -> DataFrame:
    """Distinct (ticker, date) on which a C-suite insider sold on the open market."""
    from insidertrail.functions.scalars import is_csuite

    senior = roles.where(is_csuite("role_title")).select("insider_id", "company_id").distinct()
    return (transactions.where(F.col("transaction_code") == "S")
            .join(senior, ["insider_id", "company_id"], "left_semi")
            .join(companies.select("company_id", "ticker"), "company_id")
            .select("ticker", F.col("transaction_date").alias("date")).distinct())


def event_value(transactions: DataFrame, condition: Column) -> DataFrame:
    """Same-day event value per (insider, company, date) over matching rows."""
    return (transactions.where(condition & F.col("total_value").isNotNull())
            .groupBy(*EVENT_KEY).agg(F.sum("total_value").alias("same_day_total")))


def event_value_or_fallback() -> Column:
    """Event total, else the row's own value, else shares x price; zero counts as missing."""
    from insidertrail.functions.scalars import truthy

    return F.coalesce(truthy("same_day_total"), truthy("total_value"),
                      F.col("shares") * F.coalesce(F.col("price_per_share"), F.lit(0.0)))


def daily_insider_values(transactions: DataFrame) -> DataFrame:
    return (transactions.where(F.col("is_discretionary") & (F.col("total_value") > 0))
            .groupBy("insider_id", "transaction_date").agg(F.sum("total_value").alias("day_value")))


def median_buy_value(transactions: DataFrame) -> DataFrame:
    """Upper median of an insider's daily buy values (at most one row per day each)."""
    ordered = W.partitionBy("insider_id").orderBy("day_value", "transaction_date")
    whole = W.partitionBy("insider_id")
    return (daily_insider_values(transactions)
            .withColumns({"_i": F.row_number().over(ordered), "_n": F.count(F.lit(1)).over(whole)})
            .where(F.col("_i") == F.floor(F.col("_n") / 2) + 1)
            .select("insider_id", F.col("day_value").alias("median_value")))


def sold_fraction(transactions: DataFrame) -> DataFrame:
    """Shares sold on a day as a fraction of holdings before the sale."""
    sells = transactions.where(F.col("transaction_code") == "S")
    agg = sells.groupBy(*EVENT_KEY).agg(
        F.sum("shares").alias("sold"), F.max_by("shares_owned_after", "txn_id").alias("left_after"))
    before = F.col("left_after") + F.col("sold")
    return agg.select(*EVENT_KEY, F.when(
        F.col("left_after").isNotNull() & (F.col("sold") > 0) & (before > 0),
        F.col("sold") / before).alias("sell_pct"))


def recent_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; only n candidates per key leave a map task."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
