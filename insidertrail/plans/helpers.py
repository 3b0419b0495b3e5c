"""Small shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insidertrail.operators import events as E
from insidertrail.operators import flags as FL
from insidertrail.operators.outcomes import outcomes_for_transactions
from insidertrail.plans.adapter import Tables


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounds floating results so that two engines' summation orders agree."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def big(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def people(t: Tables) -> DataFrame:
    """Insiders, written once per application: a small file is broadcast, the trades joined to it stay in place."""
    return t.stage("insiders", lambda: t.insiders)


def firms(t: Tables) -> DataFrame:
    """Companies, written once per application."""
    return t.stage("companies", lambda: t.companies)


def titles(t: Tables) -> DataFrame:
    """Roles, written once per application."""
    return t.stage("roles", lambda: t.roles)


def daily_prices(t: Tables) -> DataFrame:
    """Daily prices, written once per application."""
    return t.stage("prices", lambda: t.prices)


def outcomes(t: Tables) -> DataFrame:
    """Outcome table, written once per application."""
    return t.stage("trade_outcomes", lambda: compute_outcomes(t))


def compute_outcomes(t: Tables) -> DataFrame:
    return outcomes_for_transactions(t.transactions, firms(t), daily_prices(t))


def buy_events(t: Tables) -> DataFrame:
    """Matured buy events, written once per application."""
    return t.stage("buy_events", lambda: compute_buy_events(t))


def compute_buy_events(t: Tables) -> DataFrame:
    return E.collapse_lots(E.matured_buys(t.transactions, outcomes(t), t.companies, t.insiders))


def compute_flagged(t: Tables) -> DataFrame:
    return FL.flagged_buys(buy_events(t), t.prices, t.roles,
                           cut=lambda df: t.stage("priced_buys", lambda: df))


def flagged(t: Tables) -> DataFrame:
    """Flagged buy table, written once per application."""
    return t.stage("flagged_buys", lambda: compute_flagged(t))


def scores(t: Tables) -> DataFrame:
    """Global insider scores, written once per application."""
    from insidertrail.operators.scores import insider_scores

    return t.stage("insider_scores", lambda: insider_scores(t.transactions, outcomes(t), people(t)))
