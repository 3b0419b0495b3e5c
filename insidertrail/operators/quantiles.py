"""Exact quantiles of a column of any size.

Equal values are collapsed into (value, count), range-partitioned and written once.  The
partition holding each wanted rank follows from the partition counts, and only those
partitions are sorted; their number grows with the data.  The result is the linearly
interpolated quantile of the whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.operators.staged import written


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with ``n`` and ``edges`` (array of doubles, one per probability)."""
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    sliced = written(counts.repartitionByRange("_v").withColumn("_slice", F.spark_partition_id()), "quantile-counts")
    per_slice = sliced.groupBy("_slice").agg(F.sum("_n").alias("_in_slice"))
    # One row per partition from here on.
    order = W.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    starts = per_slice.select(
        "_slice", F.coalesce(F.sum("_in_slice").over(order), F.lit(0)).alias("_before"), "_in_slice",
        F.sum("_in_slice").over(everything).alias("_total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                       for i, p in enumerate(probs)])
    position = F.col("_q.p") * (F.col("_total") - 1)
    ends = (starts.select("*", F.explode(wanted).alias("_q"))
            .select("*", F.explode(F.array(
                F.struct(F.lit("lo").alias("end"), F.floor(position).alias("rank")),
                F.struct(F.lit("hi").alias("end"), F.ceil(position).alias("rank")))).alias("_e"))
            .where((F.col("_e.rank") >= F.col("_before"))
                   & (F.col("_e.rank") < F.col("_before") + F.col("_in_slice"))))
    inside = W.partitionBy("_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ends = written(ends, "quantile-ranks")  # two rows per probability
    ranked = (sliced.join(F.broadcast(ends.select("_slice").distinct()), "_slice", "left_semi")
              .withColumn("_upto", F.sum("_n").over(inside)))
    local = F.col("_e.rank") - F.col("_before")
    picked = (ends.join(ranked, "_slice")
              .where((local >= F.col("_upto") - F.col("_n")) & (local < F.col("_upto"))))
    per_prob = (picked.groupBy(F.col("_q.i").alias("i"), position.alias("pos"), F.col("_total").alias("n"))
                .agg(F.max(F.when(F.col("_e.end") == "lo", F.col("_v"))).alias("lo"),
                     F.max(F.when(F.col("_e.end") == "hi", F.col("_v"))).alias("hi")))
    edge = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return (per_prob.groupBy("n")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", edge.alias("edge")))),
                             lambda s: s["edge"]).alias("edges")))


def right_closed_bucket(value: Column, edges: Column, n_edges: int) -> Column:
    """1 + number of edges strictly below the value; NULL when edges repeat."""
    below = F.size(F.filter(edges, lambda e: e < value)) + 1
    distinct = F.size(F.array_distinct(edges)) == n_edges
    return F.when(value.isNotNull() & distinct, below.cast("double"))
