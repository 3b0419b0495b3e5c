"""Serving tables: feeds, scorecards, company and insider pages, health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.functions.scalars import is_csuite
from insidertrail.operators.events import common_or_unknown, recent_per_key
from insidertrail.operators.single import single_row

CONVICTION_LABELS = {5: "Very Strong", 4: "Strong", 3: "Moderate", 2: "Weak", 1: "Noise"}


def by_conviction() -> list[Column]:
    return [F.col("conviction_score").desc(), F.col("transaction_id")]


def alert_feed(alerts: DataFrame, transactions: DataFrame, *, since: Column, min_conviction: float = 0.0,
               kinds: list[str] | None = None, ticker_companies: DataFrame | None = None,
               skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of common-stock alerts by conviction, without filtered-out ones."""
    rows = alerts.where((F.col("trade_date") >= since) & (F.col("alert_type") != "filtered_out"))
    if min_conviction > 0:
        rows = rows.where(F.col("conviction_score") >= min_conviction)
    if kinds:
        rows = rows.where(F.col("alert_type").isin(kinds))
    if ticker_companies is not None:
        rows = rows.join(ticker_companies.select("company_id"), "company_id", "left_semi")
    common = transactions.where(common_or_unknown()).select(F.col("txn_id").alias("transaction_id"))
    return (rows.join(common, "transaction_id", "left_semi")
            .orderBy(*by_conviction()).offset(skip).limit(limit))


def conviction_labels(feed: DataFrame) -> DataFrame:
    """1-5 rating by percentile of conviction within the rendered page (a limited row set)."""
    one = F.lit(1)
    everyone = W.partitionBy(one)
    ordered = everyone.orderBy("conviction_score")
    n = F.count(one).over(everyone)
    below = F.rank().over(ordered) - 1
    upto = F.cume_dist().over(ordered) * n
    pct = (below + upto + 1) / (2 * n)
    level = (F.when(n == 1, 5).when(pct > 0.95, 5).when(pct > 0.85, 4).when(pct > 0.60, 3)
             .when(pct > 0.30, 2).otherwise(1))
    names = F.create_map(*[x for k, v in CONVICTION_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return feed.withColumn("conviction_display", level).withColumn(
        "conviction_label", F.element_at(names, F.col("conviction_display")))


def elite_only(alerts: DataFrame, scores: DataFrame) -> DataFrame:
    return alerts.join(scores.where("tier = 'Elite'").select("insider_id"), "insider_id", "left_semi")


def recommendations(enriched: DataFrame, drawdowns: DataFrame, *, tradeable: list[str], since: Column,
                    threshold: float | None, limit: int = 10) -> DataFrame:
    """Strongest tradeable alerts; those deep enough under their high come first."""
    top = (enriched.where(F.col("alert_type").isin(tradeable) & (F.col("trade_date") >= since))
           .orderBy(*by_conviction()).limit(limit))
    passes = F.lit(True) if threshold is None else F.coalesce(F.col("drawdown") <= threshold, F.lit(True))
    ranked = top.join(drawdowns, "ticker", "left").withColumn("passes_drawdown", passes)
    w = W.partitionBy(F.lit(1)).orderBy(F.col("passes_drawdown").desc(), *by_conviction())
    return ranked.withColumn("position", F.row_number().over(w))


def this_week(alerts: DataFrame, *, kinds: list[str], as_of: Column, days: int = 7, fallback_days: int = 30,
              limit: int = 25) -> DataFrame:
    """Strongest alerts of the last week, or of the last month when the week has none."""
    month = alerts.where(F.col("alert_type").isin(kinds) & (F.col("trade_date") >= F.date_sub(as_of, fallback_days)))
    recent = F.col("trade_date") >= F.date_sub(as_of, days)
    has_recent = single_row(month.agg(F.coalesce(F.bool_or(recent), F.lit(False)).alias("found")))["found"]
    return (month.withColumn("_any", has_recent).where(recent | ~F.col("_any"))
            .drop("_any").orderBy(*by_conviction()).limit(limit))


def sell_warnings(alerts: DataFrame, *, kinds: list[str], as_of: Column, days: int = 30, limit: int = 15) -> DataFrame:
    return (alerts.where(F.col("alert_type").isin(kinds) & (F.col("trade_date") >= F.date_sub(as_of, days)))
            .orderBy(F.col("trade_date").desc(), "transaction_id").limit(limit))


def scorecards(alerts: DataFrame, outcomes: DataFrame, roles: DataFrame, *, tradeable: list[str],
               since: Column) -> DataFrame:
    """Signals, 60-day hit rate and mean excess over all, C-suite and other insiders."""
    title = roles.groupBy("insider_id", "company_id").agg(F.min("role_title").alias("role_title"))
    rows = (alerts.where(F.col("alert_type").isin(tradeable) & (F.col("trade_date") >= since))
            .join(outcomes.select(F.col("txn_id").alias("transaction_id"), "hit_60d", "excess_return_60d"),
                  "transaction_id")
            .join(title, ["insider_id", "company_id"], "left")
            .withColumn("csuite", is_csuite("role_title")))
    agg = rows.groupingSets([[], ["csuite"]], "csuite").agg(
        F.grouping("csuite").alias("_all"), F.count(F.lit(1)).alias("total_signals"),
        F.avg(F.col("hit_60d").cast("int")).alias("hit_rate_60d"), F.avg("excess_return_60d").alias("avg_excess_60d"))
    bucket = F.when(F.col("_all") == 1, "all").when(F.col("csuite"), "csuite").otherwise("other")
    return agg.select(bucket.alias("bucket"), "total_signals", "hit_rate_60d", "avg_excess_60d")


def weekly_clusters(buys: DataFrame, *, since: Column) -> DataFrame:
    """ISO weeks of a company in which at least two insiders bought."""
    rows = buys.where(F.col("transaction_date") >= since)
    week = F.concat(F.date_part(F.lit("YEAROFWEEK"), "transaction_date").cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear("transaction_date").cast("string"), 2, "0"))
    return (rows.groupBy("company_id", week.alias("week"))
            .agg(F.count_distinct("insider_id").alias("num_insiders"), F.count(F.lit(1)).alias("num_trades"),
                 F.sum(F.coalesce("total_value", F.lit(0.0))).alias("total_value"))
            .where("num_insiders >= 2"))


def exposures(positions: DataFrame, orders: DataFrame) -> DataFrame:
    """Dollars committed per ticker in open positions: order notional, else shares x entry price."""
    rows = positions.where("status = 'open'").join(
        orders.select(F.col("order_id").alias("entry_order_id"), "notional"), "entry_order_id")
    dollars = F.coalesce("notional", F.col("shares") * F.col("entry_price"), F.lit(0.0))
    return rows.groupBy("symbol").agg(F.sum(dollars).alias("exposure"))


def open_counts(positions: DataFrame) -> DataFrame:
    """Open positions per ticker (insider NULL) and per ticker and insider."""
    return (positions.where("status = 'open'")
            .groupingSets([["symbol"], ["symbol", "insider_id"]], "symbol", "insider_id")
            .agg(F.count(F.lit(1)).alias("open_positions")))


def execution_health(alerts: DataFrame, positions: DataFrame, *, tradeable: list[str], since: Column) -> DataFrame:
    """Unhealthy when tradeable alerts exist in the window but nothing was opened."""
    a = alerts.where(F.col("alert_type").isin(tradeable) & (F.col("trade_date") >= since)).agg(
        F.count(F.lit(1)).alias("tradeable_alerts"))
    p = positions.where(F.col("entry_date") >= since).agg(F.count(F.lit(1)).alias("positions_opened"))
    none = F.col("tradeable_alerts") == 0
    frozen = ~none & (F.col("positions_opened") == 0)
    reason = (F.when(none, F.lit("no tradeable alerts in window"))
              .when(frozen, F.format_string("%d tradeable alert(s) but 0 positions opened", "tradeable_alerts"))
              .otherwise(F.format_string("%d of %d alert(s) traded", "positions_opened", "tradeable_alerts")))
    return a.withColumn("positions_opened", single_row(p)["positions_opened"]).select("tradeable_alerts", "positions_opened", (~frozen).alias("healthy"),
                                  reason.alias("reason"))


def reconciliation_health(positions: DataFrame, *, since: Column) -> DataFrame:
    recent = F.col("exit_date") >= since
    agg = positions.agg(
        F.count_if((F.col("status") == "delisted") & recent).alias("delisted_count"),
        F.count_if((F.col("close_reason") == "orphan_no_sell") & recent).alias("orphan_count"),
        F.count_if(F.col("reconcile_hold") & F.col("status").isin("open", "closing")).alias("held_count"))
    return agg.withColumn("healthy", (F.col("delisted_count") == 0) & (F.col("orphan_count") == 0)
                          & (F.col("held_count") == 0))


def insider_profiles(insiders: DataFrame, scores: DataFrame, roles: DataFrame) -> DataFrame:
    n_roles = roles.groupBy("insider_id").agg(F.count(F.lit(1)).alias("n_roles"))
    return insiders.join(scores, "insider_id", "left").join(n_roles, "insider_id", "left")


def insider_trades(transactions: DataFrame, outcomes: DataFrame, companies: DataFrame) -> DataFrame:
    """Common-stock buys with outcome where one exists, and the ticker."""
    rows = transactions.where(F.col("is_discretionary") & common_or_unknown())
    return (rows.join(companies.select("company_id", "ticker"), "company_id")
            .join(outcomes.select("txn_id", "excess_return_60d", "hit_60d"), "txn_id", "left"))


def company_insiders(roles: DataFrame, insiders: DataFrame, scores: DataFrame, companies: DataFrame) -> DataFrame:
    return (roles.join(insiders.select("insider_id", "name"), "insider_id")
            .join(scores.select("insider_id", "tier", "skill_score"), "insider_id", "left")
            .join(companies.select("company_id", "ticker"), "company_id"))


def company_buys(transactions: DataFrame, insiders: DataFrame, companies: DataFrame,
                 since: Column | None = None) -> DataFrame:
    """Common-stock buys of each company with the buyer's name, all or from a day on, and their place from the newest."""
    rows = transactions.where(F.col("is_discretionary") & common_or_unknown())
    if since is not None:
        rows = rows.where(F.col("transaction_date") >= since)
    newest = W.partitionBy("company_id").orderBy(F.col("transaction_date").desc(), "txn_id")
    return (rows.withColumn("position", F.row_number().over(newest))
            .join(insiders.select("insider_id", "name"), "insider_id")
            .join(companies.select("company_id", "ticker"), "company_id"))


def price_slice(prices: DataFrame, ticker: str, since: Column | None = None) -> DataFrame:
    rows = prices.where(F.col("ticker") == ticker.strip().upper())
    return (rows if since is None else rows.where(F.col("date") >= since)).orderBy("date")


def portfolio_summary(positions: DataFrame, orders: DataFrame, *, recent: int = 20) -> DataFrame:
    """Open positions, the last closed ones and the last orders, labelled by section."""
    def shaped(df, section, key, day, state):
        return df.select(F.lit(section).alias("section"), F.col(key).alias("id"), "symbol",
                         F.col(day).alias("day"), state.alias("state"))

    closed = (positions.where(F.col("status").isin("closed", "delisted"))
              .orderBy(F.col("exit_date").desc(), F.col("position_id").desc()).limit(recent))
    last_orders = orders.orderBy(F.col("created_on").desc(), F.col("order_id").desc()).limit(recent)
    return (shaped(positions.where("status = 'open'"), "open", "position_id", "entry_date", F.col("status"))
            .unionByName(shaped(closed, "closed", "position_id", "exit_date", F.col("status")))
            .unionByName(shaped(last_orders, "order", "order_id", "created_on", F.col("side"))))


def due_exits(positions: DataFrame, as_of: Column) -> DataFrame:
    return positions.where((F.col("status") == "open") & (F.col("exit_target_date") <= as_of))


def stop_loss_breaches(positions: DataFrame, quotes: DataFrame, stop_loss: float | None) -> DataFrame:
    """Open positions whose return at the quoted price is at or under the (negative) limit."""
    held = positions.where((F.col("status") == "open") & (F.col("entry_price") > 0) & (F.col("shares") > 0))
    ret = (F.col("ask_price") - F.col("entry_price")) / F.col("entry_price")
    rows = held.join(quotes.where(F.col("ask_price") > 0), "symbol").withColumn("current_return", ret)
    if stop_loss is None or stop_loss >= 0:
        return rows.where(F.lit(False))
    return rows.where(F.col("current_return") <= stop_loss)


def recent_trades(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    return recent_per_key(rows, key, [F.col("transaction_date").desc(), F.col("txn_id").desc()], n)


# --- reconciliation ---------------------------------------------------------

_DUST = 0.01


def reconcile(positions: DataFrame, snapshot: DataFrame, *, sells: DataFrame, actions: DataFrame, assets: DataFrame,
              last_bars: DataFrame, as_of: Column, mass_limit: int = 2, sleeve: str = "SPY") -> DataFrame:
    """Positions whose symbol vanished from the broker, with the booking decided for each.

    snapshot(symbol, qty), sells(symbol, sell_price), actions(symbol, kind,
    new_symbol, raw_type), assets(symbol, asset_status), last_bars(symbol,
    bar_price).  More than ``mass_limit`` vanished symbols at once hold every
    position for review instead.
    """
    live = positions.where(F.col("status").isin("open", "closing") & ~F.coalesce("reconcile_hold", F.lit(False))
                           & (F.col("symbol") != sleeve))
    held = live.groupBy("symbol").agg(F.sum("shares").alias("db_shares"))
    qty = snapshot.groupBy("symbol").agg(F.sum("qty").alias("qty"))
    gone = (held.join(qty, "symbol", "left")
            .where((F.col("db_shares") >= _DUST) & (F.coalesce("qty", F.lit(0.0)) < _DUST)).select("symbol"))
    # One row per symbol from here; the count is a single number.
    total = single_row(gone.agg(F.count(F.lit(1)).alias("n_gone")))["n_gone"]
    sold = sells.where(F.col("sell_price") > 0).groupBy("symbol").agg(F.max("sell_price").alias("sell_price"))
    new_qty = qty.select(F.col("symbol").alias("new_symbol"), F.col("qty").alias("new_qty"))
    facts = (gone.withColumn("n_gone", total).join(sold, "symbol", "left")
             .join(actions.dropDuplicates(["symbol"]), "symbol", "left").join(new_qty, "new_symbol", "left")
             .join(assets.dropDuplicates(["symbol"]), "symbol", "left")
             .join(last_bars.dropDuplicates(["symbol"]), "symbol", "left"))
    sell, kind, asset = F.col("sell_price").isNotNull(), F.col("kind"), F.coalesce("asset_status", F.lit("unknown"))
    named = F.coalesce(F.col("new_symbol"), F.lit("")) != ""
    confirmed = F.coalesce(F.col("new_qty") > _DUST, F.lit(False))
    null = F.lit(None).cast("string")

    def booking(action, status, reason, hold):
        return F.struct(F.lit(action).alias("action"), (status if isinstance(status, Column) else F.lit(status))
                        .cast("string").alias("new_status"), reason.alias("reason"), F.lit(hold).alias("hold"))

    renamed = F.concat(F.lit("renamed_from:"), F.col("symbol"))
    decided = (
        F.when(F.col("n_gone") > mass_limit, booking("mass_hold", null, F.lit("mass_disappearance_hold"), True))
        .when(sell, booking("sold", "closed", F.lit("sold"), False))
        .when(kind == "lookup_failed", booking("needs_review", null, F.lit("ca_lookup_failed"), True))
        .when((kind == "name_change") & named & confirmed, booking("rename", "open", renamed, False))
        .when((kind == "name_change") & named,
              booking("rename", "open", F.concat(renamed, F.lit(";broker_missing")), True))
        .when(kind == "name_change", booking("needs_review", null, F.lit("malformed_name_change"), True))
        .when(kind == "other", booking("needs_review", null, F.concat(
            F.lit("ca_needs_review:"), F.coalesce("raw_type", F.lit(""))), True))
        .when(kind.isNotNull(), booking("needs_review", null, F.concat(F.lit("ca_unhandled:"), kind), True))
        .when(asset.isin("not_found", "inactive"), booking("delisted", "delisted", F.lit("delisted"), False))
        .when(asset == "active", booking("orphan_close", "closed", F.lit("orphan_no_sell"), False))
        .otherwise(booking("needs_review", null, F.lit("reconcile_uncertain"), True)))
    price = (F.when(F.col("d.action") == "sold", F.col("sell_price"))
             .when(F.col("d.action") == "delisted", F.lit(0.0))
             .when(F.col("d.action") == "orphan_close", F.col("bar_price")))
    per_symbol = facts.withColumn("d", decided).select(
        "symbol", "d.action", "d.new_status", "d.reason", "d.hold", price.alias("booked_price"),
        F.when(F.col("d.action") == "rename", F.col("new_symbol")).alias("renamed_to"))
    closing = F.col("new_status").isin("closed", "delisted") & (F.col("entry_price") > 0)
    return live.join(per_symbol, "symbol").select(
        "position_id", "symbol", "action", F.coalesce("renamed_to", "symbol").alias("new_symbol"),
        F.coalesce("new_status", "status").alias("new_status"), F.col("reason").alias("close_reason"),
        F.col("hold").alias("reconcile_hold"), F.col("booked_price").alias("exit_price"),
        F.when(F.col("new_status").isin("closed", "delisted"), as_of).alias("exit_date"),
        F.when(closing, (F.col("booked_price") - F.col("entry_price")) * F.col("shares")).alias("pnl"),
        F.when(closing, (F.col("booked_price") - F.col("entry_price")) / F.col("entry_price")).alias("pnl_pct"))
