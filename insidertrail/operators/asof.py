"""As-of and positional lookups against per-key daily series.

A series has at most one row per (key, day), so one key never holds more rows
than there are days in the calendar.  Lookup requests are reduced to distinct
(key, day) pairs before anything is sorted; a key that carries a third of all
events therefore still sorts only a calendar's worth of rows in its task, and
the events pick the answer up with an equi join on (key, day), which adaptive
execution can split when a single day is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bracket(requests: DataFrame, series: DataFrame, *, key: str = "ticker", on: str = "date",
            request_on: str = "as_of", values: Sequence[str] = ("adj_close",),
            prev: bool = True, next: bool = True, strict: bool = False,
            frames: Mapping[str, Column] | None = None) -> DataFrame:
    """Nearest series rows around each distinct (key, request day).

    ``prev`` is the last row on or before the day and ``next`` the first on or
    after it (strictly before / after with ``strict``).  Both are structs of
    ``on`` plus ``values``, NULL where no such row exists.  ``frames`` adds window
    columns over the merged rows (``_day``, and ``_row`` on series rows only), so
    that other per-request aggregates share the same shuffle.
    """
    asked = (requests.select(F.col(key), F.col(request_on).alias("_day"))
             .where(F.col(key).isNotNull() & F.col("_day").isNotNull()).distinct())
    row = F.struct(F.col(on), *[F.col(v) for v in values if v != on])
    stream = series.select(F.col(key), F.col(on).alias("_day"), row.alias("_row"),
                           F.lit(0).alias("_ask"))
    empty = F.lit(None).cast(stream.schema["_row"].dataType)
    both = stream.unionByName(asked.select(key, "_day", empty.alias("_row"), F.lit(1).alias("_ask")))
    # On a shared day the request sees the series row unless the lookup is strict.
    tie = F.col("_ask").desc() if strict else F.col("_ask")
    out = [F.col(key), F.col("_day").alias(request_on)]
    if prev:
        w = W.partitionBy(key).orderBy(F.col("_day"), tie).rowsBetween(W.unboundedPreceding, 0)
        both = both.withColumn("_prev", F.last("_row", ignorenulls=True).over(w))
        out.append(F.col("_prev").alias("prev"))
    if next:
        w = (W.partitionBy(key).orderBy(F.col("_day").desc(), tie)
             .rowsBetween(W.unboundedPreceding, 0))
        both = both.withColumn("_next", F.last("_row", ignorenulls=True).over(w))
        out.append(F.col("_next").alias("next"))
    if frames:
        both = both.withColumns(dict(frames))
        out += [F.col(name) for name in frames]
    return both.where("_ask = 1").select(*out)


def attach(events: DataFrame, answers: DataFrame, *, key: str = "ticker", on: str,
           request_on: str = "as_of", how: str = "left") -> DataFrame:
    """Join per-(key, day) answers back to the events that asked for them."""
    return events.join(answers.withColumnRenamed(request_on, on), [key, on], how)


def nearest(day: Column, prev: Column, next: Column, value: str, *, within_days: int = 5,
            on: str = "date", not_after: Column | None = None) -> Column:
    """Value of the closest bracketed row within tolerance; the later row wins ties."""
    before = F.datediff(day, prev[on])
    after = F.datediff(next[on], day)
    ok_after = after <= within_days
    if not_after is not None:
        ok_after = ok_after & (next[on] <= not_after)
    ok_before = before <= within_days
    return (F.when(ok_after & (~F.coalesce(ok_before, F.lit(False)) | (after <= before)), next[value])
            .when(ok_before, prev[value]))


def with_leads(series: DataFrame, steps: Sequence[int], *, key: str = "ticker", on: str = "date",
               value: str = "adj_close", prefix: str = "fwd") -> DataFrame:
    """Adds ``{prefix}{n}`` structs: the row n positions later in the key's series."""
    w = W.partitionBy(key).orderBy(on)
    pick = F.struct(F.col(on), F.col(value))
    return series.withColumns({
        f"{prefix}{n}": (pick if n == 0 else F.lead(pick, n).over(w)) for n in sorted(set(steps))})


def nth_after(events: DataFrame, *, key: str = "ticker", on: str = "date", k: int = 1) -> DataFrame:
    """Distinct event days per key, each with the day of the (k-1)-th later event."""
    w = W.partitionBy(key).orderBy(on)
    days = events.select(key, on).where(F.col(on).isNotNull()).distinct()
    kth = F.col(on) if k == 1 else F.lead(on, k - 1).over(w)
    return days.withColumn("kth_date", kth)
