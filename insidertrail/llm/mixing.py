"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import WORD, attach_small, cut, global_rank, table

SEED = "mix-1"


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(2 ** 52)


def source_rates(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, weight, target and rate.

    Sources in code-point order, null last, get the weights in turn.  The mix holds ``share`` times all
    sizes, dealt by weight; a source stops at ``cap`` times its size and the excess is dealt again among
    the others until none is above.  A source without words has target and rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, F.col("source").asc_nulls_last(), "mix-sources")
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(ranked.select("source", "source_size", by_turn.alias("weight")), "mix-weights")
    most = F.lit(float(cap)) * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        above = most < F.lit(level) * F.col("weight")
        got = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if got["n"] == capped or got["open"] == 0:
            break
        capped, level = got["n"], (share * float(got["all"]) - got["used"]) / got["open"]
    target = F.when(above, most).otherwise(F.least(F.lit(level) * F.col("weight"), most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def with_copies(rows: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """``rows`` (with columns ``__source`` and ``__key`` key) plus source_size, target and copies."""
    rates = cut(rates, "mix-rates")
    small = rates.select(F.col("source").alias("____source"), "source_size", "target", "rate")
    joined = attach_small(rows, small, "__source", rates.count())
    whole = F.floor("rate")
    extra = (uniform(F.col(key)) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop("rate")


def document_sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("__source"), size.alias("size"))


def mixture_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                 **options) -> DataFrame:
    """One row per document: key, size, source_size, target and copies.

    Native DataFrame operations only.  Null or empty texts have size 0 and are copied like others of
    their source.  Repeated rows are documents of their own; rows with one key share the Bernoulli draw
    (a null key draws as the empty string).  An empty table gives no rows.
    """
    sizes = cut(document_sizes(docs, key, text, source), "mix-sizes")
    rates = source_rates(sizes.select(F.col("__source").alias("source"), "size"), **options)
    return with_copies(sizes, rates, "key").select(F.col("key").alias(key), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with all its own columns."""
    sizes = document_sizes(docs, key, text, source)
    rates = source_rates(sizes.select(F.col("__source").alias("source"), "size"), **options)
    rows = docs.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), F.col(key).alias("__id"))
    taken = with_copies(rows, rates, "__id")
    return (taken.withColumn("__turn", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            .select("__row.*"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
              ELSE 1.0::DOUBLE END AS weight
  FROM sizes GROUP BY source),
ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS used,
         (sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0) AS open
  FROM sources
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max((total - used) / open) AS level FROM ordered),
rates AS (
  SELECT source, source_size,
         least(level * weight, most) AS target
  FROM ordered, level),
drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM sizes d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn
"""
