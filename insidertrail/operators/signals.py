"""Live features, strategies as column logic, alert generation and sizing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.operators import asof, events as E
from insidertrail.operators.clusters import visible_members
from insidertrail.operators.flags import first_observed
from insidertrail.operators.prices import price_panel
from insidertrail.operators.single import single_row
from insidertrail.operators.staged import written
from insidertrail.params import SIGNALS, SignalParams

# --- signal types and strategies -------------------------------------------


@dataclass(frozen=True)
class SignalType:
    name: str
    direction: str = "buy"
    tradeable: bool = False
    hold_days: int = 60
    priority: int = 0
    visible: bool = True
    description: str = ""


FILTERED_OUT = SignalType("filtered_out", visible=False)


@dataclass(frozen=True)
class Strategy:
    """A strategy is a set of column expressions over the feature table.

    ``classify`` names the signal of a buy row, ``evaluate_sell`` of a sell row
    (NULL for no alert), ``conviction`` ranks it, ``size_pct`` gives the share of
    equity and ``allow_entry`` a rejection reason (NULL to accept).
    """

    name: str
    types: tuple[SignalType, ...]
    classify: Column
    conviction: Column = field(default_factory=lambda: F.lit(1.0))
    evaluate_sell: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    size_pct: Column = field(default_factory=lambda: F.lit(0.05))
    allow_entry: Column = field(default_factory=lambda: concentration_reason())

    def registry(self, spark: SparkSession) -> DataFrame:
        return signal_registry(spark, self.types)

    def names(self, *, direction: str | None = None, tradeable: bool | None = None,
              visible: bool | None = None) -> list[str]:
        return sorted(s.name for s in self.types
                      if (direction is None or s.direction == direction)
                      and (tradeable is None or s.tradeable == tradeable)
                      and (visible is None or s.visible == visible))


def signal_registry(spark: SparkSession, types: tuple[SignalType, ...] | list[SignalType]) -> DataFrame:
    names = [s.name for s in types]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate signal type name(s): {repeated}")
    schema = ("name string, direction string, tradeable boolean, hold_days int, priority int, "
              "visible boolean, description string")
    return spark.createDataFrame([(s.name, s.direction, s.tradeable, s.hold_days, s.priority, s.visible,
                                   s.description) for s in types], schema)


def concentration_reason(p: SignalParams = SIGNALS) -> Column:
    """Reason to refuse an entry; negative counts mean "not known yet"."""
    return (F.when(F.col("open_for_insider_ticker") >= p.max_per_insider_ticker, "insider_ticker_limit")
            .when(F.col("open_in_ticker") >= p.max_per_ticker, "ticker_limit"))


def _value() -> Column:
    return F.coalesce(F.col("txn_value"), F.lit(0.0))


def _planned() -> Column:
    return F.coalesce(F.col("is_10b5_1_plan"), F.lit(False))


def cluster_buy(min_insiders: int = 2, min_value: float = 25_000.0) -> Strategy:
    hit = (F.coalesce(F.col("cluster_unique_insiders"), F.lit(0)) >= min_insiders) & (_value() >= min_value)
    return Strategy("cluster_buy", (
        SignalType("cluster_buy", tradeable=True, priority=50,
                   description="several distinct insiders bought within the cluster window"), FILTERED_OUT),
        F.when(hit, "cluster_buy").otherwise("filtered_out"))


def big_exec_buy(min_value: float = 100_000.0) -> Strategy:
    senior = S.is_ceo("role_title") | S.is_cfo("role_title")
    hit = senior & (_value() >= min_value) & ~_planned()
    return Strategy("big_exec_buy", (
        SignalType("big_exec_buy", tradeable=True, priority=50,
                   description="large CEO or CFO purchase outside a trading plan"), FILTERED_OUT),
        F.when(hit, "big_exec_buy").otherwise("filtered_out"))


def opportunistic_first_buy(min_value: float = 25_000.0) -> Strategy:
    hit = F.coalesce(F.col("is_first_buy"), F.lit(False)) & (_value() >= min_value) & ~_planned()
    return Strategy("opportunistic_first_buy", (
        SignalType("opportunistic_first_buy", tradeable=True, priority=50,
                   description="first observed purchase outside a trading plan"), FILTERED_OUT),
        F.when(hit, "opportunistic_first_buy").otherwise("filtered_out"))


def classify_flagged(flagged: DataFrame, strategy: Strategy) -> DataFrame:
    """Signal of each row of the flagged buy table (its columns under feature names)."""
    view = flagged.withColumns({"txn_value": F.col("total_value"),
                                "cluster_unique_insiders": F.col("cluster_size")})
    return view.withColumn("signal_type", F.coalesce(strategy.classify, F.lit("skip"))).drop(
        "txn_value", "cluster_unique_insiders")


# --- live features ----------------------------------------------------------


def live_cluster_counts(transactions: DataFrame, insiders: DataFrame,
                        days: int = SIGNALS.cluster_window_days) -> DataFrame:
    """People buying and selling each (company, day) within +-days, the day itself included."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    rows = transactions.join(people, "insider_id", "left_semi")

    def count(condition, name):
        return visible_members(rows.where(condition), transactions, before=days, after=days
                               ).withColumnRenamed("n_members", name)

    keys = ["company_id", "transaction_date"]
    return count(F.col("is_discretionary"), "unique_buyers").join(
        count(F.col("transaction_code") == "S", "unique_sellers"), keys)


def peer_skill(transactions: DataFrame, insiders: DataFrame, scores: DataFrame,
               days: int = SIGNALS.cluster_window_days) -> DataFrame:
    """Number, sum and mean of the skill scores of the cluster members per (company, day)."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    rows = (transactions.where("is_discretionary").join(people, "insider_id", "left_semi")
            .join(scores.select("insider_id", "skill_score"), "insider_id", "left"))
    # Decimals keep running sums exact, in any order, however many members come and go.
    exact = F.coalesce(F.col("skill_score").cast("decimal(27,18)"), F.lit(0).cast("decimal(27,18)"))
    seen = visible_members(rows, transactions, before=days, after=days, measures={
        "peers_scored": F.col("skill_score").isNotNull().cast("int"), "exact": exact})
    total = F.col("exact").cast("double")
    return seen.select("company_id", "transaction_date", "peers_scored", total.alias("peer_skill_sum"),
                       F.when(F.col("peers_scored") > 0, total / F.col("peers_scored")).alias("peer_skill_avg"))


def live_features(rows: DataFrame, transactions: DataFrame, insiders: DataFrame, companies: DataFrame,
                  roles: DataFrame, prices: DataFrame, scores: DataFrame, *, few: bool = False) -> DataFrame:
    """Every live feature for the given transactions, one row per input row.

    With ``few`` the stored tables are first cut down to what the rows can see: their insiders, companies and
    tickers, and for the cluster windows the days around theirs.  The rows come out the same.
    """
    out = rows.join(companies.select("company_id", "ticker"), "company_id")
    around, own = transactions, transactions
    if few:
        asked = written(rows.select("insider_id", "company_id", "transaction_date").distinct(), "asked-events")
        days = single_row(asked.agg(F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last")))
        reach = SIGNALS.cluster_window_days
        around = transactions.where(
            F.col("transaction_date").between(F.date_sub(days["first"], reach), F.date_add(days["last"], reach))).join(
            asked.select("company_id").distinct(), "company_id", "left_semi")
        people = asked.select("insider_id").distinct()
        own = transactions.join(people, "insider_id", "left_semi")
        roles = roles.join(people, "insider_id", "left_semi")
        tickers = companies.join(asked.select("company_id").distinct(), "company_id", "left_semi").select("ticker").distinct()
        prices = prices.join(tickers, "ticker", "left_semi")
    panel = price_panel(prices).select("ticker", "date", "ret_60", "ret_5")
    found = asof.bracket(out.select("ticker", F.col("transaction_date").alias("as_of")), panel,
                         values=["ret_60", "ret_5"], next=False)
    out = asof.attach(out, found, on="transaction_date")
    dropped = F.coalesce(F.col("prev.ret_60") <= -0.15, F.lit(False))
    out = out.withColumns({
        "is_drawdown": dropped,
        "prior_return_60td": F.when(dropped, F.col("prev.ret_60")),
        "short_momentum_5d": F.when(dropped, F.col("prev.ret_5")),
        "still_falling": dropped & F.coalesce(F.col("prev.ret_5") < 0, F.lit(False)),
    }).drop("prev")
    day = ["company_id", "transaction_date"]
    out = (out.join(live_cluster_counts(around, insiders), day, "left")
           .join(peer_skill(around, insiders, scores), day, "left")
           .join(E.median_buy_value(own), "insider_id", "left")
           .join(E.sold_fraction(own), E.EVENT_KEY, "left"))
    buys = own.where(F.col("is_discretionary"))
    observed = first_observed(buys.where(E.common_or_unknown()))
    only = (buys.groupBy("insider_id", "company_id").agg(
        F.count(F.lit(1)).alias("_buys"), F.max("txn_id").alias("_only")))
    role = roles.groupBy("insider_id", "company_id").agg(
        F.min_by("role_title", "first_filing_date").alias("_title"),
        F.min("first_filing_date").alias("_since"))
    out = (out.join(observed, "insider_id", "left").join(only, ["insider_id", "company_id"], "left")
           .join(role, ["insider_id", "company_id"], "left")
           .join(scores.select("insider_id", "skill_score", "tier"), "insider_id", "left"))
    no_other_here = F.col("_buys").isNull() | ((F.col("_buys") == 1) & (F.col("_only") == F.col("txn_id")))
    tenured = F.datediff("transaction_date", "_since") / 365.25 >= 2
    return out.withColumns({
        "cluster_unique_insiders": F.coalesce("unique_buyers", F.lit(0)),
        "cluster_sell_unique": F.coalesce("unique_sellers", F.lit(0)),
        "insider_median_value": F.coalesce("median_value", F.lit(SIGNALS.default_median_value)),
        "is_10b5_1_plan": _planned(),
        "is_first_buy": F.coalesce(F.struct("transaction_date", "txn_id") <= F.col("first_event"), F.lit(True)),
        "is_first_time": no_other_here & F.coalesce(tenured, F.lit(False)),
        "role_title": F.coalesce("_title", F.lit("Other")),
        "skill_score": F.coalesce("skill_score", F.lit(0.0)),
        "tier": F.coalesce("tier", F.lit("Insufficient")),
    }).drop("unique_buyers", "unique_sellers", "median_value", "first_event", "_buys", "_only", "_title", "_since")


# --- alerts -----------------------------------------------------------------

ALERT_COLUMNS = ["transaction_id", "insider_id", "company_id", "alert_type", "conviction_score",
                 "insider_skill_score", "transaction_value", "summary", "trade_date"]


def _alerts(rows: DataFrame, kind: Column, conviction: Column) -> DataFrame:
    return rows.withColumn("alert_type", kind).where(F.col("alert_type").isNotNull()).select(
        F.col("txn_id").alias("transaction_id"), "insider_id", "company_id", "alert_type",
        conviction.alias("conviction_score"), F.col("skill_score").alias("insider_skill_score"),
        F.col("txn_value").alias("transaction_value"),
        F.concat(F.col("alert_type"), F.lit(": "), F.col("ticker"), F.lit(" "),
                 F.col("transaction_date").cast("string")).alias("summary"),
        F.col("transaction_date").alias("trade_date"))


def _first_of_event(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in E.EVENT_KEY]
    return (rows.groupBy(*E.EVENT_KEY).agg(F.min_by(F.struct(*rest), "txn_id").alias("_r"))
            .select(*E.EVENT_KEY, "_r.*"))


def _alerted(existing: DataFrame | None, kinds: list[str] | None = None) -> DataFrame | None:
    if existing is None:
        return None
    rows = existing if kinds is None else existing.where(F.col("alert_type").isin(kinds))
    return rows.select("insider_id", "company_id", F.col("trade_date").alias("transaction_date"))


def buy_alerts(strategy: Strategy, transactions: DataFrame, insiders: DataFrame, companies: DataFrame,
               roles: DataFrame, prices: DataFrame, scores: DataFrame, *, existing: DataFrame | None = None,
               since: Column | None = None, only: DataFrame | None = None,
               p: SignalParams = SIGNALS) -> DataFrame:
    """One alert per (insider, company, trade date) that has none yet.

    ``since`` limits how old a trade may be and ``only`` which rows are considered
    (a new batch); features and the event value cover every stored lot.
    """
    rows = E.person_buys(transactions if only is None else only, insiders)
    if since is not None:
        rows = rows.where(F.col("transaction_date") >= since)
    done = _alerted(existing)
    if done is not None:
        rows = E.without_matches(rows, done, E.EVENT_KEY)
    few = only is not None or since is not None or done is not None
    totals = E.event_value(transactions, F.col("is_discretionary"))
    if not few:  # an event's trades then meet where they lie, not in a shuffle of all of them
        totals = written(totals, "event-values")
    rows = (rows.join(totals, E.EVENT_KEY, "left").withColumn("txn_value", E.event_value_or_fallback())
            .where(S.value_in_bounds("txn_value", p.min_event_value, p.max_event_value)))
    rows = _first_of_event(rows)
    if not few:
        rows = written(rows, "events")
    features = live_features(rows, transactions, insiders, companies, roles, prices, scores, few=few)
    return _alerts(features, strategy.classify, strategy.conviction)


def sell_alerts(strategy: Strategy, transactions: DataFrame, insiders: DataFrame, companies: DataFrame,
                roles: DataFrame, prices: DataFrame, scores: DataFrame, *,
                existing: DataFrame | None = None) -> DataFrame:
    """One alert per sell event the strategy finds worth flagging."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    rows = (transactions.where((F.col("transaction_code") == "S") & E.common_or_unknown())
            .join(people, "insider_id", "left_semi"))
    done = _alerted(existing, strategy.names(direction="sell", visible=True))
    if done is not None:
        rows = E.without_matches(rows, done, E.EVENT_KEY)
    few = done is not None
    totals = E.event_value(transactions, F.col("transaction_code") == "S")
    if not few:
        totals = written(totals, "event-values")
    rows = (rows.join(totals, E.EVENT_KEY, "left")
            .withColumn("txn_value", F.coalesce(E.event_value_or_fallback(), F.lit(0.0))))
    rows = _first_of_event(rows)
    if not few:
        rows = written(rows, "events")
    features = live_features(rows, transactions, insiders, companies, roles, prices, scores, few=few)
    return _alerts(features, strategy.evaluate_sell, strategy.conviction)


def person_alerts(alerts: DataFrame, transactions: DataFrame, insiders: DataFrame, *,
                  hidden: list[str] | None = None, since: Column | None = None) -> DataFrame:
    """Alerts on common stock by people, without hidden types."""
    rows = alerts if since is None else alerts.where(F.col("trade_date") >= since)
    if hidden:
        rows = rows.where(~F.col("alert_type").isin(hidden))
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    # Of the trades only those alerted are shuffled: few alerts are broadcast to them.
    common = (transactions.where(E.common_or_unknown()).select(F.col("txn_id").alias("transaction_id"))
              .join(rows.select("transaction_id"), "transaction_id", "left_semi"))
    return rows.join(people, "insider_id", "left_semi").join(common, "transaction_id", "left_semi")


def enrich_alerts(alerts: DataFrame, insiders: DataFrame, companies: DataFrame, scores: DataFrame,
                  roles: DataFrame) -> DataFrame:
    """Adds names, ticker, global score and role."""
    one_role = roles.groupBy("insider_id", "company_id").agg(F.min("role_title").alias("role_title"))
    return (alerts.join(insiders.select("insider_id", F.col("name").alias("insider_name")), "insider_id", "left")
            .join(companies.select("company_id", "ticker", "sector"), "company_id", "left")
            .join(scores.select("insider_id", "tier", "skill_score", "bayesian_hit_rate"), "insider_id", "left")
            .join(one_role, ["insider_id", "company_id"], "left")
            .withColumns({"tier": F.coalesce("tier", F.lit("Insufficient")),
                          "role_title": F.coalesce("role_title", F.lit("Other"))}))


# --- sizing -----------------------------------------------------------------


def position_size(equity: float, *, liquidity: bool = False, mixed_roles: bool = False,
                  adv_cap_pct: float | None = None, size_pct: Column | None = None,
                  vol_target_k: float | None = None, p: SignalParams = SIGNALS) -> dict[str, Column]:
    """Dollars per position from role share, optional boosts, volatility target and volume cap."""
    role_pct = F.when(S.is_csuite("role_title"), F.lit(p.csuite_size_pct)).otherwise(F.lit(p.base_size_pct))
    pct = size_pct if size_pct is not None else role_pct
    if vol_target_k is not None:
        target = F.greatest(F.lit(p.vol_target_min_pct),
                            F.least(F.lit(p.vol_target_max_pct), vol_target_k / F.col("realized_vol")))
        pct = F.coalesce(target, pct)
    elif size_pct is None:
        if liquidity:
            pct = pct * F.when(F.col("liquidity_quintile") <= 2, 1.25).otherwise(1.0)
        if mixed_roles:
            pct = pct * F.when(F.coalesce("cluster_has_mixed_roles", F.lit(False)), 1.15).otherwise(1.0)
    dollars = pct * equity
    if adv_cap_pct is not None:
        dollars = F.when(F.col("adv_dollar_20d") > 0,
                         F.least(dollars, adv_cap_pct * F.col("adv_dollar_20d"))).otherwise(dollars)
    return {"position_pct": pct, "position_dollars": dollars}
