"""Exits and sizes as levers of a specification, and the spread of results over orders of trades.

A trade carries a lattice: for every hold length and every set of exit rules where it ends, and for every sizing what it
costs.  The lattice is built once; specifications differ only in the point they look at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.functions import scalars as S
from insidertrail.functions.scalars import ATOMS
from insidertrail.operators import asof
from insidertrail.operators import research as R
from insidertrail.params import SIGNALS, SignalParams

NOTIONAL = 500.0
# Sizings by name: the factor on the notional for a strength k.
SIZINGS: dict[str, Callable[[float], Column]] = {
    "csuite": lambda k: F.when(S.is_csuite("role_title"), F.lit(1.0 + k)).otherwise(F.lit(1.0)),
}
TRADE = ("txn_id", "insider_id", "ticker", "known_on", "sizes", "lattice")


def trade_lattice(flagged: DataFrame, prices: DataFrame, hold_days: Sequence[int], base_signal: Column, *,
                  exits: Mapping[str, DataFrame], sizes: Sequence[tuple] = (R.FLAT,),
                  sizings: Mapping[str, Callable[[float], Column]] = SIZINGS, atoms: Mapping = ATOMS,
                  notional: float = NOTIONAL) -> DataFrame:
    """One row per trade: own atom bits, entry, ``sizes`` (cost per sizing) and ``lattice``.

    A lattice point is (hold_days, exit_bits, exit_date, pnl_pct, forced).  The exit of a set of rules comes from the
    set without its last rule: the last rule's first event after entry ends the trade where it triggers before that exit.
    ``exits`` maps rule names to events as the ledger makes them (ticker, date, xq).  A trade that nothing ends closes
    at the last price and is forced.
    """
    rows = flagged.withColumns({"own": R.own_bits(base_signal, atoms), "known_on": F.coalesce("filing_date", "transaction_date"),
                                "sizes": F.array(*[notional * (F.lit(1.0) if name is None else sizings[name](k)) for name, k in sizes])})
    led = asof.with_leads(prices.select("ticker", "date", "adj_close"), list(hold_days))
    whole = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    series = led.withColumn("final", F.last(F.struct("date", "adj_close")).over(whole))
    holds = [f"fwd{h}" for h in hold_days]
    found = asof.bracket(rows.select("ticker", F.col("known_on").alias("as_of")), series, prev=False,
                         values=["adj_close", "final", *holds])
    out = asof.attach(rows, found, on="known_on").where(F.col("next.adj_close") > 0)
    out = out.select("txn_id", "insider_id", "ticker", "known_on", "own", "sizes", F.col("next.date").alias("entry_date"),
                     F.col("next.adj_close").alias("entry_price"), F.col("next.final").alias("final"),
                     *[F.col(f"next.{c}").alias(f"{c}_0") for c in holds])
    for i, events in enumerate(exits.values()):
        first = asof.bracket(out.select("ticker", F.col("entry_date").alias("as_of")), events, values=["xq"], prev=False, strict=True)
        out = asof.attach(out, first, on="entry_date")
        event = F.col("next.xq")

        def ended(exit_row: Column) -> Column:
            sooner = event["row"]["date"].isNotNull() & (exit_row["date"].isNull() | (event["trigger"] < exit_row["date"]))
            return F.when(sooner, event["row"]).otherwise(exit_row)

        out = out.withColumns({f"{c}_{m | 1 << i}": ended(F.col(f"{c}_{m}")) for c in holds for m in range(1 << i)}).drop("next")

    def point(h: int, m: int) -> Column:
        at = F.col(f"fwd{h}_{m}")
        return F.struct(F.lit(h).alias("hold_days"), F.lit(m).alias("exit_bits"), F.coalesce(at["date"], F.col("final.date")).alias("exit_date"),
                        (F.coalesce(at["adj_close"], F.col("final.adj_close")) / F.col("entry_price") - 1).alias("pnl_pct"),
                        at["date"].isNull().alias("forced"))

    points = F.array(*[point(h, m) for h in hold_days for m in range(1 << len(exits))])
    return out.select("txn_id", "insider_id", "ticker", "known_on", "own", "sizes", "entry_date", "entry_price", points.alias("lattice"))


def counted_lattice(trades: DataFrame, required: Sequence[int], windows: Sequence[tuple]) -> DataFrame:
    """Trades as they count for the atom sets in use, with their lattice; see ``research.counted_trades``."""
    return R.counted_trades(trades, required, windows, by=(), carried=TRADE)


def lever_metrics(counted: DataFrame, required: Sequence[int], *, capital: float = 10_000.0) -> DataFrame:
    """``research.cell_metrics`` per (required, hold_days, window, exit_bits, size_index).

    Points are taken apart inside the task and added up there before anything is shuffled.
    """
    points = counted.select("bits", "exact", "window", "txn_id", "sizes", F.explode("lattice").alias("at"))
    rows = points.select("bits", "exact", "window", "txn_id", "at.*", F.posexplode("sizes").alias("size_index", "size"))
    return R.cell_metrics(rows.withColumn("pnl", F.col("size") * F.col("pnl_pct")), required, capital=capital, levers=R.LEVERS)


def _draw(seed: int, txn_id: int) -> str:
    return hashlib.md5(f"{seed}:{txn_id}".encode()).hexdigest()


def order_spread(counted: DataFrame, required: Sequence[int], *, seeds: Sequence[int], capital: float = 10_000.0,
                 p: SignalParams = SIGNALS) -> DataFrame:
    """(required, hold_days, window, exit_bits, size_index, mean_ret, cv): how returns spread over orders within days.

    Under each seed the trades of a day come in the order of ``md5(seed:txn_id)`` and are taken while fewer than the
    limits are open per ticker, and per insider and ticker.  ``cv`` is the population deviation of the returns over
    their mean (0 where that is 0).

    A ticker of a cell is folded once, for all seeds together: what is open is a matrix of seeds by slots.  No row is
    copied for a seed.  Of a ticker and day only rows among the first ``2 * max_per_ticker`` of some seed can matter
    (the taken ones, and one refusal per insider with a position open), so a group has a bounded number of rows a day.
    """
    per_insider, slots, seeds = p.max_per_insider_ticker, p.max_per_ticker, list(seeds)
    most = 2 * slots
    sets = F.when(F.col("exact"), F.array("bits")).otherwise(R._sets_within(F.col("bits"), required))
    rows = counted.withColumn("required", F.explode(sets))
    day = ["required", "window", "ticker", "known_on"]
    sized = rows.withColumn("of_day", F.count(F.lit(1)).over(W.partitionBy(*day)))
    ranked = sized.where(F.col("of_day") > most).withColumns(
        {f"rank_{s}": R.seeded_rank(F.lit(s), day) for s in seeds})
    first = ranked.where(F.least(*[f"rank_{s}" for s in seeds]) <= most) if len(seeds) > 1 else ranked.where(
        F.col(f"rank_{seeds[0]}") <= most)
    kept = sized.where(F.col("of_day") <= most).unionByName(first.drop(*[f"rank_{s}" for s in seeds]))
    points = kept.select("required", "window", "ticker", "insider_id", "txn_id", F.unix_date("known_on").alias("day"), "sizes",
                         F.explode("lattice").alias("at"))
    points = points.select(
        "required", "at.hold_days", "window", "at.exit_bits", "ticker", "insider_id", "txn_id", "day",
        F.when(F.col("at.forced"), F.lit(2 ** 31 - 1)).otherwise(F.unix_date("at.exit_date")).alias("closes"),
        F.transform("sizes", lambda s: s * F.col("at.pnl_pct")).alias("pnl"))
    group = ["required", "hold_days", "window", "exit_bits"]

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "txn_id"])
        who, closes, txn = pdf["insider_id"].to_numpy(), pdf["closes"].to_numpy(), pdf["txn_id"].to_numpy()
        days, pnl = pdf["day"].to_numpy(), np.array(pdf["pnl"].tolist(), float)
        holder = np.zeros((len(seeds), slots), who.dtype)
        until = np.full((len(seeds), slots), -2 ** 31, np.int64)  # a slot is free from this day on
        total = np.zeros((len(seeds), pnl.shape[1]))
        starts = np.flatnonzero(np.r_[True, days[1:] != days[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(days)]):
            order = np.full((len(seeds), b - a), a)
            if b - a > 1:
                order = np.array([sorted(range(a, b), key=lambda i: (_draw(s, txn[i]), txn[i])) for s in seeds])
            for trade in order.T:  # the next trade of the day, one per seed
                open_now = until > days[a]
                mine = (open_now & (holder == who[trade][:, None])).sum(axis=1)
                at = np.flatnonzero((mine < per_insider) & ~open_now.all(axis=1))
                slot = open_now[at].argmin(axis=1)
                holder[at, slot], until[at, slot] = who[trade[at]], closes[trade[at]]
                total[at] += pnl[trade[at]]
        return pd.DataFrame({**dict(zip(group, key[:4])), "seed": seeds, "pnl": list(total)})

    folded = points.groupBy(*group, "ticker").applyInPandas(
        fold, "required int, hold_days int, window string, exit_bits int, seed int, pnl array<double>")
    returns = (folded.select(*group, "seed", F.posexplode("pnl").alias("size_index", "pnl"))
               .groupBy(*group, "size_index", "seed").agg((F.sum("pnl") / capital).alias("ret")))
    mean, apart = F.avg("ret"), F.stddev_pop("ret")
    return returns.groupBy(*R.CELL, *R.LEVERS).agg(
        mean.alias("mean_ret"), F.when((mean != 0) & (apart > 0), apart / mean).otherwise(F.lit(0.0)).alias("cv"))


def with_spread(metrics: DataFrame, spread: DataFrame) -> DataFrame:
    """Cell metrics with the spread over orders in place of the 0 of unlimited trades."""
    cell = [*R.CELL, *R.LEVERS]
    return metrics.drop("cv").join(spread.select(*cell, "cv"), cell, "left").withColumn("cv", F.coalesce("cv", F.lit(0.0)))
