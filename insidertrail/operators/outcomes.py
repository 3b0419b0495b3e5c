"""Forward returns of buys against a benchmark and a sector fund."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators import asof
from insidertrail.operators.staged import written

HORIZONS = (20, 60, 120)
LOOKAHEAD_DAYS = 200
LOOKBACK_DAYS = 40


def with_momentum_base(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Adds ``back``: the price ``rows`` - 1 positions earlier."""
    w = W.partitionBy("ticker").orderBy("date")
    return prices.withColumn("back", F.lag("adj_close", rows - 1).over(w))


def momentum_frames(back_days: int = LOOKBACK_DAYS, key: str = "ticker") -> dict[str, Column]:
    """Count, first and last row of [day-40, day-1] for ``asof.bracket``."""
    number = F.datediff("_day", F.lit("1970-01-01").cast("date"))
    span = W.partitionBy(key).orderBy(number).rangeBetween(-back_days, -1)
    return {"m_count": F.count("_row").over(span),
            "m_first": F.first("_row", ignorenulls=True).over(span),
            "m_last": F.last("_row", ignorenulls=True).over(span)}


def momentum_value(rows: int = 20, min_rows: int = 5) -> Column:
    start = F.when(F.col("m_count") >= rows, F.col("m_last.back")).otherwise(F.col("m_first.adj_close"))
    return F.when(F.col("m_count") >= min_rows, S.simple_return(start, F.col("m_last.adj_close")))


def prior_momentum(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Return over the last 20 rows of [day-40, day-1], per distinct (ticker, day)."""
    found = asof.bracket(requests, with_momentum_base(prices), values=["adj_close", "back"],
                         prev=False, next=False, frames=momentum_frames())
    return found.select("ticker", "as_of", momentum_value().alias("prior_momentum_20d"))


def trade_outcomes(trades: DataFrame, prices: DataFrame, *, benchmark: str = "SPY",
                   horizons: tuple[int, ...] = HORIZONS, taxonomy: dict | None = None) -> DataFrame:
    """Outcome per (ticker, sector fund, transaction_date) found in ``trades``.

    A row exists when both the stock and the benchmark have a price within five
    days of the trade.  The N-th later trading day counts stock rows strictly
    after the trade and within 200 calendar days; benchmark and sector prices are
    the nearest ones to that day.  Horizon columns stay NULL when not reached.
    """
    fund = S.sector_fund("sector", taxonomy or S.OUTCOME_SECTOR_FUNDS)
    keys = (trades.select("ticker", fund.alias("fund"), F.col("transaction_date").alias("as_of"))
            .where(F.col("ticker").isNotNull() & F.col("as_of").isNotNull()).distinct())
    steps = sorted({n for h in horizons for n in (h, h - 1)})
    series = with_momentum_base(asof.with_leads(prices.select("ticker", "date", "adj_close"), steps))
    around = asof.bracket(keys, series, values=["adj_close", "back", *[f"fwd{n}" for n in steps]],
                          frames=momentum_frames())
    limit = F.date_add("as_of", LOOKAHEAD_DAYS)
    base = asof.nearest(F.col("as_of"), F.col("prev"), F.col("next"), "adj_close", not_after=limit)

    def later(h):
        # A price on the trade day itself is not "after" it.
        row = F.when(F.col("next.date") == F.col("as_of"), F.col(f"next.fwd{h}")).otherwise(
            F.col(f"next.fwd{h - 1}"))
        return F.when(row["date"] <= limit, row)

    stock = around.select("ticker", "as_of", base.alias("base"), momentum_value().alias("prior_momentum_20d"),
                          *[later(h).alias(f"f{h}") for h in horizons])
    dated = keys.join(stock, ["ticker", "as_of"]).where(F.col("base").isNotNull())

    # Reference prices wanted: benchmark and sector fund, on the trade day (h = 0)
    # and on every horizon day the stock reached.
    moments = F.array(F.struct(F.lit(0).alias("h"), F.col("as_of").alias("at")),
                      *[F.struct(F.lit(h).alias("h"), F.col(f"f{h}.date").alias("at")) for h in horizons])
    series_names = F.array(F.struct(F.lit("bench").alias("role"), F.lit(benchmark).alias("name")),
                           F.struct(F.lit("sector").alias("role"), F.col("fund").alias("name")))
    wanted = (dated.select("ticker", "fund", "as_of", F.explode(moments).alias("m"),
                           series_names.alias("s")).where(F.col("m.at").isNotNull())
              .select("ticker", "fund", "as_of", "m.*", F.explode("s").alias("s"))
              .select("ticker", "fund", "as_of", "h", "at", "s.*").where(F.col("name").isNotNull()))
    known = asof.bracket(wanted.select("name", "at"), prices.select(
        F.col("ticker").alias("name"), "date", "adj_close"), key="name", request_on="at")
    near = asof.nearest(F.col("at"), F.col("prev"), F.col("next"), "adj_close", not_after=limit)
    found = wanted.join(known, ["name", "at"]).withColumn("px", near)
    wide = found.groupBy("ticker", "fund", "as_of").agg(*[
        F.max(F.when((F.col("h") == h) & (F.col("role") == role), F.col("px"))).alias(f"{role}_{h}")
        for role in ("bench", "sector") for h in (0, *horizons)]).withColumnsRenamed(
            {"ticker": "_t", "fund": "_f", "as_of": "_d"})
    wide = wide.where(F.col("bench_0").isNotNull())
    out = dated.join(wide, (F.col("ticker") == F.col("_t")) & (F.col("as_of") == F.col("_d"))
                     & F.col("fund").eqNullSafe(F.col("_f")))
    cols = []
    for h in horizons:
        ok = F.col(f"f{h}").isNotNull() & F.col(f"bench_{h}").isNotNull()
        stock_ret = F.when(ok, S.simple_return(F.col("base"), F.col(f"f{h}.adj_close")))
        bench_ret = F.when(ok, S.simple_return(F.col("bench_0"), F.col(f"bench_{h}")))
        sector_ret = F.when(ok & F.col(f"sector_{h}").isNotNull() & F.col("sector_0").isNotNull(),
                            S.simple_return(F.col("sector_0"), F.col(f"sector_{h}")))
        cols += [stock_ret.alias(f"stock_return_{h}d"), bench_ret.alias(f"benchmark_return_{h}d"),
                 sector_ret.alias(f"sector_return_{h}d"), (stock_ret - bench_ret).alias(f"excess_return_{h}d"),
                 (stock_ret - bench_ret > 0).alias(f"hit_{h}d")]
    matured = F.col(f"f{max(horizons[:2])}.date").alias("matured_on")
    return out.select("ticker", "fund", F.col("as_of").alias("transaction_date"), "prior_momentum_20d",
                      matured, *cols)


def outcomes_for_transactions(transactions: DataFrame, companies: DataFrame, prices: DataFrame,
                              **kwargs) -> DataFrame:
    """Outcome row per discretionary transaction (``txn_id``)."""
    trades = (transactions.where("is_discretionary").select("txn_id", "company_id", "transaction_date")
              .join(companies.select("company_id", "ticker", "sector"), "company_id"))
    fund = S.sector_fund("sector", kwargs.get("taxonomy") or S.OUTCOME_SECTOR_FUNDS)
    # A calendar per ticker at most; as a small file it is broadcast to the trades.
    per_day = written(trade_outcomes(trades, prices, **kwargs), "daily-outcomes").withColumnRenamed("fund", "_fund")
    t = trades.withColumn("fund", fund)
    same = (t["ticker"] == per_day["ticker"]) & (t["transaction_date"] == per_day["transaction_date"]) \
        & t["fund"].eqNullSafe(per_day["_fund"])
    return t.join(per_day, same).select(
        t["txn_id"], *[per_day[c] for c in per_day.columns if c not in ("ticker", "_fund", "transaction_date")])
