"""Distinct-member counts over moving day windows, without pairing rows.

"How many different insiders traded this company within N days" is a sweep:
each (company, insider) contributes disjoint stretches of days on which it is
visible, a stretch is a +1 at its first day and a -1 after its last, and the
answer on any day is the running sum.  Rows are first reduced to distinct
(company, insider, day); the running sum works on at most one row per company
and day, so neither a hot company nor a hot insider grows a task beyond the
calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible_members(members: DataFrame, queries: DataFrame, *, group: str = "company_id",
                    member: str = "insider_id", on: str = "transaction_date",
                    before: int = 7, after: int = 0,
                    measures: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct (group, day) of ``queries``: members seen in [day-before, day+after].

    ``measures`` sums a per-member number over the visible members (it must be
    the same on every row of one member in one group).  ``n_members`` is always
    produced.
    """
    named = {"n_members": F.lit(1), **(measures or {})}
    names = list(named)
    day = F.col("_day")
    base = (members.where(F.col(group).isNotNull() & F.col(member).isNotNull() & F.col(on).isNotNull())
            .groupBy(group, member, F.col(on).alias("_day"))
            .agg(*[F.max(c).alias(n) for n, c in named.items()]))
    per_member = W.partitionBy(group, member).orderBy("_day")
    first_seen = F.date_sub(day, after)
    gone = F.date_add(day, before + 1)
    next_seen = F.date_sub(F.lead("_day").over(per_member), after)
    stretches = base.select(group, first_seen.alias("_from"),
                            F.least(gone, next_seen).alias("_to"), *names)
    edges = stretches.select(group, *names, F.explode(F.array(
        F.struct(F.col("_from").alias("day"), F.lit(1).alias("sign")),
        F.struct(F.col("_to").alias("day"), F.lit(-1).alias("sign")))).alias("_edge"))
    deltas = (edges.groupBy(group, F.col("_edge.day").alias("_day"))
              .agg(*[F.sum(F.col(n) * F.col("_edge.sign")).alias(n) for n in names]))
    asked = (queries.select(F.col(group), F.col(on).alias("_day"))
             .where(F.col(group).isNotNull() & F.col("_day").isNotNull()).distinct())
    both = (deltas.withColumn("_ask", F.lit(0))
            .unionByName(asked.withColumns({n: F.lit(0).cast(deltas.schema[n].dataType) for n in names})
                         .withColumn("_ask", F.lit(1))))
    running = (W.partitionBy(group).orderBy("_day", "_ask")
               .rowsBetween(W.unboundedPreceding, 0))
    return (both.withColumns({n: F.sum(n).over(running) for n in names})
            .where("_ask = 1").select(group, F.col("_day").alias(on), *names))


def rows_in_window(rows: DataFrame, *, group: list[str], on: str = "transaction_date",
                   before: int = 7, after: int = 0, name: str = "n_rows") -> DataFrame:
    """Per distinct (group, day): number of rows in [day-before, day+after]."""
    number = F.datediff(F.col(on), F.lit("1970-01-01").cast("date"))
    daily = rows.groupBy(*group, on).agg(F.count(F.lit(1)).alias("_n")).withColumn("_num", number)
    w = W.partitionBy(*group).orderBy("_num").rangeBetween(-before, after)
    return daily.withColumn(name, F.sum("_n").over(w)).drop("_n", "_num")
