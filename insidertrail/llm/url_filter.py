"""URL filters: rules by host and path, and trust and distrust spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import ascii_lower, cut, table

# (verdict, host, path): what the query judges by.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
# Hosts of absolute and scheme-relative links; links within the page's own host have none.
LINKED_HOST = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
THRESHOLD = 0.08
ROUNDS = 20


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(text, HOST, 1))).withColumn(
        "path", F.regexp_extract(text, PATH, 1))


def match_rules(pages: DataFrame, rules) -> DataFrame:
    """``pages`` (with host and path) plus ``rule`` and ``rule_verdict`` of the longest rule that fits.

    Every host looks up its own name and the names above it among the rule hosts; pages then test the paths
    of the rules found.  Of equally long rules the one with the longer host counts.
    """
    spark = pages.sparkSession
    known = spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.concat("rule_host", "rule_path")
    fits = (hosts.select("host", F.explode(above).alias("rule_host")).join(known, "rule_host").groupBy("host")
            .agg(F.collect_list(F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"),
                                         rule.alias("rule"), "rule_path", "rule_verdict")).alias("rules")))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    return (pages.join(fits, "host", "left").withColumn("best", best)
            .withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict"))
            .drop("rules", "best"))


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): pages of ``src`` that link to ``dst``, another host; added up before the shuffle."""
    linked = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINKED_HOST), F.lit(1)), ascii_lower))
    return (pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
            .filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, seed): the allowed share of a host's pages as trust, the blocked share as distrust."""
    shares = judged.filter("host <> ''").groupBy("host").agg(
        *[(F.count(F.when(F.col("rule_verdict") == v, 1)) / F.count(F.lit(1))).alias(v) for v in ("allow", "block")])
    return shares.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))).alias("s")).select(
        "s.kind", "host", "s.seed").filter("seed > 0")


def propagate(links: DataFrame, start: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
              tolerance: float = 1e-9) -> DataFrame:
    """(kind, host, score): personalised PageRank of trust along links and of distrust against them.

    ``score = (1 - damping) * seed + damping * sum(score of the sender * its share)``; a host without links
    sends nothing on.  Scores grow from round to round, so the sum tells how far they are from their limit.
    Each round is one join and one aggregate and is written to the shared folder.
    """
    both = links.select("src", "dst", "n", F.lit("trust").alias("kind")).unionByName(
        links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(both.join(out, ["kind", "src"]).select(
        "kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "url-shares")
    base = cut(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score")), "url-seeds")
    scores, total = base, base.agg(F.sum("score")).first()[0] or 0.0
    for _ in range(rounds):
        sent = shares.join(scores, ["kind", "host"]).select(
            "kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        scores = cut(base.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores")
        before, total = total, scores.agg(F.sum("score")).first()[0] or 0.0
        if total - before <= tolerance * total:
            break
    return scores


def judge_urls(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html",
               threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per page: key, host, path, rule and verdict (``allow`` or ``block``).

    The longest rule that fits decides.  Other pages are blocked when the distrust of their host exceeds
    its trust by more than ``threshold``.  A null url, or one without ``://``, has empty host and path and
    is allowed, as is a host of which nothing is known.  Null html has no links.  Repeated rows and null keys
    give a row each and count each; an empty table gives no rows.
    """
    named = with_host_and_path(pages.select(
        F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html")), "__url")
    judged = cut(match_rules(named.select("__key", "host", "path"), rules), "url-judged")
    scores = propagate(host_links(named, "__html"), seeds(judged), **options)
    excess = (scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", -F.col("score"))
                                               .otherwise(F.col("score"))).alias("excess"))
              .filter(F.round("excess", 9) > threshold).select("host", F.lit("block").alias("host_verdict")))
    return (judged.join(excess, "host", "left")
            .select(F.col("__key").alias(key), "host", "path", "rule",
                    F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _rounds_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS (
  SELECT kind, host, sum(score) AS score FROM (
    SELECT kind, host, score FROM r0 UNION ALL
    SELECT s.kind, s.dst, {DAMPING}::DOUBLE * s.share * r.score FROM shares s JOIN r{i} r ON s.kind = r.kind AND s.host = r.host)
  GROUP BY kind, host)""")
    return ",\n".join(steps)


_LINKED_SQL = LINKED_HOST.removeprefix("(?i)").replace("'", "''")
OP6_SQL = f"""
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, RULES))}),
named AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path FROM pages),
judged AS (
  SELECT page_id, host, path,
         (SELECT max(row(length(rule_host || rule_path), length(rule_host), rule_host || rule_path, rule_verdict))
          FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM named),
hrefs AS (
  SELECT DISTINCT page_id, host AS src, unnest(list_transform(
    regexp_extract_all(coalesce(html, ''), '{_LINKED_SQL}', 1, 'i'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'))) AS dst FROM named WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM hrefs WHERE src <> dst GROUP BY src, dst),
shares AS (
  SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
host_shares AS (
  SELECT host, count(*) FILTER (best[4] = 'allow') / count(*) AS trust, count(*) FILTER (best[4] = 'block') / count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
r0 AS (
  SELECT 'trust' AS kind, host, {1 - DAMPING}::DOUBLE * trust AS score FROM host_shares WHERE trust > 0 UNION ALL
  SELECT 'distrust', host, {1 - DAMPING}::DOUBLE * distrust FROM host_shares WHERE distrust > 0),
{_rounds_sql(ROUNDS)},
blocked AS (
  SELECT host FROM r{ROUNDS} GROUP BY host
  HAVING round(sum(CASE kind WHEN 'trust' THEN -score ELSE score END), 9) > {THRESHOLD})
SELECT page_id, j.host, path, best[3] AS rule,
       coalesce(best[4], CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN blocked b ON j.host = b.host
"""
