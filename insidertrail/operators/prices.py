"""Per-row features of daily price series.

All windows run per ticker over a series with one row per trading day, so a
partition never exceeds the calendar however many trades name the ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.operators.single import single_row


def price_panel(prices: DataFrame) -> DataFrame:
    """prices(ticker, date, adj_close[, volume]) with trailing-window columns.

    Columns no query selects are pruned before the windows are evaluated.
    """
    w = W.partitionBy("ticker").orderBy("date")
    price = F.col("adj_close")
    positive = F.when(price > 0, price)
    last_positive = F.last(positive, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = prices.withColumns({
        "rn": F.row_number().over(w),
        "ret_60": price / F.lag(price, 60).over(w) - 1,
        "ret_5": price / F.lag(price, 5).over(w) - 1,
        "log_ret": F.when(price > 0, F.log(price / last_positive)),
        "price_20_back": F.lag(price, 20).over(w),
        "high_252": F.max(price).over(w.rowsBetween(-251, 0)),
        "positive_21": F.count(positive).over(w.rowsBetween(-20, 0)),
    })
    std_20 = F.stddev_samp("log_ret").over(w.rowsBetween(-19, 0))
    std_19 = F.stddev_samp("log_ret").over(w.rowsBetween(-18, 0))
    vol = F.when(F.col("price_20_back") <= 0, std_19).otherwise(std_20)
    extra = {
        # 21 closes give 20 returns; one non-positive close may be skipped over.
        "realized_vol": F.when((F.col("rn") >= 21) & (F.col("positive_21") >= 20) & (vol > 0), vol),
        "high_52w": F.when((F.col("rn") >= 20) & (F.col("high_252") > 0), F.col("high_252")),
    }
    if "volume" in prices.columns:
        extra["avg_volume_20d"] = F.when(
            F.col("rn") >= 20, F.avg("volume").over(w.rowsBetween(-19, 0)))
        extra["adv_dollar_20d"] = F.when(
            F.col("rn") >= 20, F.avg(price * F.col("volume")).over(w.rowsBetween(-19, 0)))
    return out.withColumns(extra).drop("log_ret", "price_20_back", "high_252", "positive_21")


def cross_section_percentiles(panel: DataFrame) -> DataFrame:
    """Share of tickers below each ticker's volatility and dollar volume on the day."""
    def rank_of(name):
        w = W.partitionBy("date", F.col(name).isNull()).orderBy(name)
        return F.when(F.col(name).isNotNull(), F.percent_rank().over(w))

    return panel.withColumns({"vol_pctile": rank_of("realized_vol"),
                              "adv_pctile": rank_of("adv_dollar_20d")})


def current_drawdowns(prices: DataFrame, as_of, days: int = 370, min_rows: int = 20) -> DataFrame:
    """Latest price against the highest price of the last ``days`` days, per ticker."""
    recent = prices.where(F.col("date") >= F.date_sub(as_of, days))
    agg = recent.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.max("adj_close").alias("high"),
        F.max_by("adj_close", "date").alias("latest"))
    dd = (F.col("latest") - F.col("high")) / F.col("high")
    return agg.select("ticker", F.when((F.col("n") >= min_rows) & (F.col("high") > 0), dd).alias("drawdown"))


def missing_coverage(prices: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requested (ticker, start_date, end_date) ranges with too few stored days.

    About 5/7 of calendar days should be trading days; two may be missing.
    """
    from insidertrail.operators.asof import bracket

    w = W.partitionBy("ticker").orderBy("date")
    numbered = prices.select("ticker", "date").distinct().withColumn("rn", F.row_number().over(w))
    edges = ranges.select("ticker", F.explode(F.array(
        F.col("end_date"), F.date_sub("start_date", 1))).alias("as_of"))
    upto = bracket(edges, numbered, values=["rn"], next=False).select(
        "ticker", "as_of", F.coalesce(F.col("prev.rn"), F.lit(0)).alias("upto"))
    span = F.datediff("end_date", "start_date")
    expected = F.greatest(F.lit(1), F.floor(span * 5 / 7)).cast("bigint")
    return (ranges.withColumn("_before", F.date_sub("start_date", 1))
            .join(upto.withColumnsRenamed({"as_of": "end_date", "upto": "_hi"}), ["ticker", "end_date"])
            .join(upto.withColumnsRenamed({"as_of": "_before", "upto": "_lo"}), ["ticker", "_before"])
            .select("ticker", "start_date", "end_date",
                    (F.col("_hi") - F.col("_lo")).cast("bigint").alias("stored_days"),
                    expected.alias("expected_days"))
            .where(F.col("stored_days") < F.col("expected_days") - 2))


def rebased_benchmark(equity: DataFrame, benchmark: DataFrame, *, anchor_on: str = "date") -> DataFrame:
    """Benchmark carried forward onto the equity dates and scaled to the first equity value.

    One row per day on both sides, so the unpartitioned window is a calendar long.
    """
    from insidertrail.operators.asof import bracket

    span = single_row(equity.agg(F.min(anchor_on).alias("first"), F.max(anchor_on).alias("last"),
                                 F.min_by("equity", anchor_on).alias("base")))
    key = F.lit("benchmark")
    series = (benchmark.select(key.alias("k"), "date", "adj_close").withColumn("_s", span)
              .where(F.col("date").between(F.col("_s.first"), F.col("_s.last"))).drop("_s"))
    carried = bracket(equity.select(key.alias("k"), F.col(anchor_on).alias("as_of")), series, key="k", next=False)
    anchor = single_row(series.agg(F.min_by("adj_close", "date").alias("price")))["price"]
    return (equity.join(carried.select(F.col("as_of").alias(anchor_on), "prev"), anchor_on, "left")
            .withColumns({"_base": span["base"], "_anchor": anchor})
            .select(anchor_on, F.round("equity", 2).alias("equity"),
                    F.round(F.col("_base") * (F.coalesce(F.col("prev.adj_close"), F.col("_anchor"))
                                              / F.col("_anchor")), 2).alias("benchmark")))
