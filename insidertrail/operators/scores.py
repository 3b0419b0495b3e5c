"""Insider skill scores: posterior hit rate, shrunk excess return, tier.

Track records are plain aggregates per insider.  The as-of form sums each
insider's events per day and keeps running sums, so a score per as-of date costs
one sort of that insider's days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from insidertrail.functions.distributions import normal_cdf
from insidertrail.operators.events import common_or_unknown, first_outcome_per_day, largest_lots
from insidertrail.params import SCORES, ScoreParams


@F.pandas_udf(DoubleType())
def beta_survival(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - I_x(a, b), the regularised incomplete beta function, for a batch of rows.

    Spark has no special functions.  The continued fraction is evaluated from the
    inside out over a fixed number of levels (about two square roots of the
    largest parameter sum), all rows at once; the converging side is chosen by
    the usual symmetry.
    """
    x, a, b = (v.to_numpy(dtype=float) for v in (x, a, b))

    def log_gamma(z):
        y = z + 3
        series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
        return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(z * (z + 1) * (z + 2))

    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tail = np.ones_like(p)
    for m in range(16 + int(2 * np.sqrt(np.nanmax(p + q, initial=1.0))), 0, -1):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = (p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        tail = 1 + even / (1 - odd / tail)
    front = np.exp(p * np.log(y) + q * np.log(1 - y) - log_gamma(p) - log_gamma(q) + log_gamma(p + q)) / p
    value = front / (1 - (p + q) * y / (p + 1) / tail)
    return pd.Series(np.where(swap, value, 1 - value))


def confidence_above_baseline(hits: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    """P(hit rate > baseline) under Beta(alpha0 + hits, beta0 + misses)."""
    return beta_survival(F.lit(p.baseline), p.alpha0 + hits, p.beta0 + (n - hits))


def posterior_hit_rate(hits: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    return (p.alpha0 + hits) / (p.alpha0 + p.beta0 + n)


def shrunk_excess(total: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    return (p.shrinkage_k * p.prior_excess + total) / (p.shrinkage_k + n)


def prob_positive(shrunk: Column, sigma: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    """P(excess return > 0) under the shrunk mean and its posterior variance."""
    return normal_cdf(shrunk * F.sqrt(p.shrinkage_k + n) / sigma)


def shrinkage_sigma(std: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    fallback = F.lit(p.default_sigma)
    return F.when((n >= 3) & (std > 0), std).otherwise(fallback)


def credibility(n: Column, p: ScoreParams = SCORES) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.sqrt(n / p.full_credibility_n)))


def skill_score(hit_rate: Column, excess: Column, weight: Column, p: ScoreParams = SCORES) -> Column:
    rate = F.greatest(F.lit(0.01), F.least(F.lit(0.99), hit_rate))
    logit = F.log(rate / (1 - rate))
    return weight * (p.w_hit_rate * logit + p.w_magnitude * excess / p.sigma_typical)


def tier(skill: Column, confidence: Column, n: Column, p: ScoreParams = SCORES) -> Column:
    return (F.when(n < p.min_n, "Insufficient")
            .when((skill >= p.elite_skill) & (confidence >= p.elite_confidence) & (n >= p.elite_n), "Elite")
            .when((skill >= p.strong_skill) & (confidence >= p.strong_confidence), "Strong")
            .when(skill >= 0.0, "Average").otherwise("Weak"))


def momentum_intercept(y: Column, x: Column, p: ScoreParams = SCORES) -> Column:
    """Excess return at zero prior momentum; NULL under five pairs or without spread."""
    paired = x.isNotNull() & y.isNotNull()
    spread = F.max(F.when(paired, x)) > F.min(F.when(paired, x))
    return F.when((F.regr_count(y, x) >= p.min_momentum_pairs) & spread, F.regr_intercept(y, x))


def track_record_aggregates(p: ScoreParams = SCORES) -> dict[str, Column]:
    y, x = F.col("excess_return_60d"), F.col("prior_momentum_20d")
    return {
        "n": F.count(y),
        "hits": F.count(F.when(F.col("hit_60d") & y.isNotNull(), 1)),
        "avg_excess_return": F.avg(y),
        "sum_excess_return": F.sum(y),
        "std_excess_return": F.stddev_samp(y),
        "momentum_intercept": momentum_intercept(y, x, p),
    }


def score_columns(records: DataFrame, p: ScoreParams = SCORES) -> DataFrame:
    """Adds the score columns; under ``min_n`` events only count, weight, tier and skill 0."""
    n, hits = F.col("n"), F.col("hits")
    enough = n >= p.min_n
    with_parts = records.withColumn("_confidence", confidence_above_baseline(hits, n, p)).withColumns({
        "raw_hit_rate": F.when(enough, hits / n),
        "bayesian_hit_rate": F.when(enough, posterior_hit_rate(hits, n, p)),
        "confidence": F.when(enough, F.col("_confidence")),
        "avg_excess_return": F.when(enough, F.col("avg_excess_return")),
        "shrunk_excess": F.when(enough, shrunk_excess(F.col("sum_excess_return"), n, p)),
        "credibility_weight": credibility(n, p),
    })
    adjusted = F.when(enough, F.coalesce(F.col("momentum_intercept"), F.col("shrunk_excess")))
    with_parts = with_parts.withColumn("momentum_adjusted_excess", adjusted)
    skill = skill_score(F.col("bayesian_hit_rate"), F.col("momentum_adjusted_excess"),
                        F.col("credibility_weight"), p)
    return (with_parts.withColumn("skill_score", F.when(enough, skill).otherwise(F.lit(0.0)))
            .withColumn("tier", tier(F.col("skill_score"), F.col("confidence"), n, p))
            .withColumn("sigma", F.when(enough, shrinkage_sigma(F.col("std_excess_return"), n, p)))
            .drop("momentum_intercept", "sum_excess_return", "std_excess_return", "_confidence"))


def scored_events(transactions: DataFrame, outcomes: DataFrame, *, common_only: bool = True) -> DataFrame:
    """Largest lot per event among discretionary rows with a 60-day outcome."""
    rows = transactions.where("is_discretionary")
    if common_only:
        rows = rows.where(common_or_unknown())
    joined = rows.select("txn_id", "insider_id", "company_id", "transaction_date", "total_value").join(
        outcomes.where(F.col("excess_return_60d").isNotNull())
        .select("txn_id", "excess_return_60d", "hit_60d", "prior_momentum_20d"), "txn_id")
    return largest_lots(joined)


def track_records(events: DataFrame, *, by_company: bool = False) -> DataFrame:
    """Track record per insider, and with ``by_company`` also per insider and company."""
    aggs = [c.alias(k) for k, c in track_record_aggregates().items()]
    if not by_company:
        return events.groupBy("insider_id").agg(*aggs)
    return events.groupingSets([["insider_id"], ["insider_id", "company_id"]],
                               "insider_id", "company_id").agg(*aggs)


def insider_scores(transactions: DataFrame, outcomes: DataFrame, insiders: DataFrame,
                   p: ScoreParams = SCORES) -> DataFrame:
    """Global score of every non-institution insider with a discretionary buy."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    everyone = (transactions.where("is_discretionary").select("insider_id").distinct()
                .join(people, "insider_id", "left_semi"))
    records = track_records(scored_events(transactions, outcomes))
    return score_columns(everyone.join(records, "insider_id", "left")
                         .fillna({"n": 0, "hits": 0}), p)


def company_scores(transactions: DataFrame, outcomes: DataFrame, insiders: DataFrame,
                   p: ScoreParams = SCORES) -> DataFrame:
    """Score of every non-institution insider in each company of which they have a discretionary buy."""
    people = insiders.where(~F.col("is_institution")).select("insider_id")
    pair = ["insider_id", "company_id"]
    pairs = transactions.where("is_discretionary").select(*pair).distinct().join(people, "insider_id", "left_semi")
    records = scored_events(transactions, outcomes).groupBy(*pair).agg(
        *[c.alias(k) for k, c in track_record_aggregates(p).items()])
    return score_columns(pairs.join(records, pair, "left").fillna({"n": 0, "hits": 0}), p)


def _daily_moments(events: DataFrame, axis: str) -> DataFrame:
    """Sums per (insider, day) from which every track-record figure follows."""
    y, x = F.col("excess_return_60d"), F.col("prior_momentum_20d")
    py = F.when(x.isNotNull(), y)
    px = F.when(y.isNotNull(), x)
    return (events.where(F.col(axis).isNotNull())
            .groupBy("insider_id", F.col(axis).alias("_day")).agg(
        F.count(y).alias("n"), F.count(F.when(F.col("hit_60d") & y.isNotNull(), 1)).alias("hits"),
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.min(y).alias("min_y"), F.max(y).alias("max_y"),
        F.count(px).alias("k"), F.sum(py).alias("spy"), F.sum(px).alias("sx"), F.sum(px * px).alias("sxx"),
        F.sum(px * py).alias("sxy"), F.min(px).alias("min_x"), F.max(px).alias("max_x")))


def as_of_scores(requests: DataFrame, events: DataFrame, *, axis: str = "transaction_date",
                 p: ScoreParams = SCORES) -> DataFrame:
    """Score per distinct (insider_id, as_of) from events strictly before ``as_of``.

    ``axis`` names the date an event becomes usable; the default is the trade
    date (an outcome that has not matured yet still counts), a maturity column
    gives the strictly causal form.  Events are summed per insider and day before
    the shuffle, so an insider sorts at most a calendar of rows.
    """
    daily = _daily_moments(events, axis).withColumn("_ask", F.lit(0))
    asked = (requests.select("insider_id", F.col("as_of").alias("_day"))
             .where(F.col("insider_id").isNotNull() & F.col("_day").isNotNull()).distinct()
             .withColumn("_ask", F.lit(1)))
    # On a shared day the request comes first: only earlier days count.
    before = (W.partitionBy("insider_id").orderBy("_day", F.col("_ask").desc())
              .rowsBetween(W.unboundedPreceding, 0))
    sums = ["n", "hits", "sy", "syy", "k", "spy", "sx", "sxx", "sxy"]
    running = (daily.unionByName(asked, allowMissingColumns=True).withColumns({
        **{c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums},
        **{c: F.min(c).over(before) for c in ("min_y", "min_x")},
        **{c: F.max(c).over(before) for c in ("max_y", "max_x")}}).where("_ask = 1"))
    n, k = F.col("n"), F.col("k")
    variance = (F.col("syy") - F.col("sy") * F.col("sy") / n) / (n - 1)
    slope = ((F.col("sxy") - F.col("sx") * F.col("spy") / k) / (F.col("sxx") - F.col("sx") * F.col("sx") / k))
    spread = (k >= p.min_momentum_pairs) & (F.col("max_x") > F.col("min_x"))
    return score_columns(running.select(
        "insider_id", F.col("_day").alias("as_of"), "n", "hits",
        F.when(n > 0, F.col("sy") / n).alias("avg_excess_return"), F.col("sy").alias("sum_excess_return"),
        F.when(F.col("max_y") > F.col("min_y"), F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0))
        .alias("std_excess_return"),
        F.when(spread, (F.col("spy") - slope * F.col("sx")) / k).alias("momentum_intercept")), p)


def cached_as_of_events(transactions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One event per (insider, trade date) over all companies, the first id kept."""
    joined = (transactions.where("is_discretionary").select("txn_id", "insider_id", "transaction_date")
              .join(outcomes.where(F.col("excess_return_60d").isNotNull())
                    .select("txn_id", "excess_return_60d", "hit_60d", "prior_momentum_20d"), "txn_id"))
    return first_outcome_per_day(joined)
