"""Flag columns of buy events: liquidity, drawdown, routine, first buy, cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators import asof
from insidertrail.operators.clusters import visible_members
from insidertrail.operators.prices import price_panel
from insidertrail.operators.quantiles import exact_quantiles, right_closed_bucket
from insidertrail.operators.single import single_row
from insidertrail.params import SIGNALS


def with_filing_lag(buys: DataFrame) -> DataFrame:
    days = S.filing_lag_days("transaction_date", "filing_date")
    return buys.withColumn("filing_lag_days", days).withColumn(
        "filing_lag_bucket", S.filing_lag_bucket("filing_lag_days"))


def routine_insiders(buys: DataFrame, min_years: int = 3) -> DataFrame:
    """Insiders active in one calendar month in at least ``min_years`` consecutive years."""
    seen = buys.select("insider_id", F.year("transaction_date").alias("y"),
                       F.month("transaction_date").alias("m")).distinct()
    w = W.partitionBy("insider_id", "m").orderBy("y")
    islands = seen.withColumn("island", F.col("y") - F.row_number().over(w))
    return (islands.groupBy("insider_id", "m", "island").count()
            .where(F.col("count") >= min_years).select("insider_id").distinct())


def with_routine(buys: DataFrame) -> DataFrame:
    marked = routine_insiders(buys).withColumn("is_routine", F.lit(True))
    return (buys.join(marked, "insider_id", "left")
            .withColumn("is_routine", F.coalesce("is_routine", F.lit(False))))


def with_first_buy(buys: DataFrame, roles: DataFrame, *, min_tenure_days: int = 730) -> DataFrame:
    """First observed buy per insider, tenure and their conjunction.

    The first event is the smallest (date, company, id); it is found by partial
    aggregation instead of sorting an insider's whole history.
    """
    firsts = buys.groupBy("insider_id").agg(
        F.min(F.struct("transaction_date", "company_id", "txn_id")).alias("_first"))
    tenure = (roles.where(F.col("first_filing_date").isNotNull()).groupBy("insider_id")
              .agg(F.min("first_filing_date").alias("_since")))
    return (buys.join(firsts, "insider_id").join(tenure, "insider_id", "left")
            .withColumn("is_first_buy", F.struct("transaction_date", "company_id", "txn_id") == F.col("_first"))
            .withColumn("tenure_days", F.datediff("transaction_date", "_since"))
            .withColumn("first_time_conviction", F.col("is_first_buy")
                        & (F.coalesce(F.col("tenure_days"), F.lit(0)) >= min_tenure_days))
            .drop("_first", "_since"))


def first_observed(transactions: DataFrame) -> DataFrame:
    """Earliest buy (date, id) of each insider."""
    return transactions.groupBy("insider_id").agg(
        F.min(F.struct("transaction_date", "txn_id")).alias("first_event"))


def role_facts(roles: DataFrame) -> DataFrame:
    """One row per (insider, company) with 0/1 role markers for cluster counts."""
    cat = S.role_category("is_officer", "is_director")
    return roles.groupBy("insider_id", "company_id").agg(
        F.max((cat == "officer").cast("int")).alias("officer"),
        F.max((cat == "director").cast("int")).alias("director"),
        F.max((cat == "10pct_owner").cast("int")).alias("owner"),
        F.max(S.is_ceo("role_title").cast("int")).alias("ceo"),
        F.max(S.is_cfo("role_title").cast("int")).alias("cfo"))


def with_cluster(buys: DataFrame, roles: DataFrame, *, causal: bool = True,
                 days: int = SIGNALS.cluster_window_days) -> DataFrame:
    """Cluster size and role mix among insiders buying the company in the window."""
    marks = ["officer", "director", "owner", "ceo", "cfo"]
    members = buys.select("company_id", "insider_id", "transaction_date").distinct().join(
        role_facts(roles), ["insider_id", "company_id"], "left")
    seen = visible_members(
        members, buys, before=days, after=0 if causal else days,
        measures={m: F.coalesce(F.col(m), F.lit(0)) for m in marks})
    mix = sum([(F.col(m) > 0).cast("int") for m in marks[:3]], F.lit(0))
    clustered = F.col("n_members") >= 2
    flags = seen.select(
        "company_id", "transaction_date", F.col("n_members").alias("cluster_size"),
        clustered.alias("is_cluster"),
        F.when(clustered, mix).otherwise(0).alias("cluster_role_diversity"),
        (clustered & (mix >= 2)).alias("cluster_has_mixed_roles"),
        (clustered & (F.col("ceo") > 0) & (F.col("cfo") > 0)).alias("cluster_has_ceo_and_cfo"))
    return buys.join(flags, ["company_id", "transaction_date"], "left")


def with_price_flags(buys: DataFrame, prices: DataFrame) -> DataFrame:
    """Drawdown, short momentum and trailing volume as of the trade date (one lookup)."""
    panel = price_panel(prices).select("ticker", "date", "ret_60", "ret_5", "avg_volume_20d")
    asked = buys.select("ticker", F.col("transaction_date").alias("as_of"))
    found = asof.bracket(asked, panel, values=["ret_60", "ret_5", "avg_volume_20d"], next=False)
    out = asof.attach(buys, found, on="transaction_date")
    falling = F.coalesce(F.col("prev.ret_60") <= -0.15, F.lit(False))
    return out.withColumns({
        "prior_return_60td": F.col("prev.ret_60"),
        "short_momentum_5d": F.col("prev.ret_5"),
        "drawdown_flag": falling,
        "still_falling": falling & F.coalesce(F.col("prev.ret_5") < 0, F.lit(False)),
        "drawdown_severity": S.drawdown_severity(F.col("prev.ret_60")),
        "avg_volume_20d": F.col("prev.avg_volume_20d"),
    }).drop("prev")


def volume_edges(buys: DataFrame) -> DataFrame:
    return exact_quantiles(buys, "avg_volume_20d", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


def with_liquidity_quintile(buys: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Quintile (1-5) of trailing volume over all buys with a volume; NULL if edges repeat."""
    edges = volume_edges(buys) if edges is None else edges
    inner = F.slice("edges", 2, 4)
    repeats = F.size(F.array_distinct("edges")) < 6
    bucket = F.when(~repeats & (F.col("n") >= 5),
                    right_closed_bucket(F.col("avg_volume_20d"), inner, 4))
    return (buys.withColumn("_q", single_row(edges)).withColumns({"edges": F.col("_q.edges"), "n": F.col("_q.n")})
            .withColumn("liquidity_quintile", bucket).drop("_q", "edges", "n"))


def flagged_buys(events: DataFrame, prices: DataFrame, roles: DataFrame, *,
                 causal_cluster: bool = True, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Buy events with every flag column.

    ``cut`` may write an intermediate result and read it back; the priced events
    are used several times (clusters, first buys, quantile edges).
    """
    from insidertrail.operators.events import with_role_title

    priced = cut(with_price_flags(with_role_title(events, roles), prices))
    out = with_cluster(priced, roles, causal=causal_cluster)
    out = out.join(with_first_buy(priced, roles).select(
        "txn_id", "is_first_buy", "tenure_days", "first_time_conviction"), "txn_id")
    out = (out.join(routine_insiders(priced).withColumn("is_routine", F.lit(True)), "insider_id", "left")
           .withColumn("is_routine", F.coalesce("is_routine", F.lit(False))))
    edges = volume_edges(priced)
    return with_filing_lag(with_liquidity_quintile(out, edges))
