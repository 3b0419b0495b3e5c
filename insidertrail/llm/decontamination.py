"""Benchmark decontamination: one Aho-Corasick automaton of the items' word windows reads every text once."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import ascii_lower, cut, table

# A word is a run of ASCII letters and digits and of any characters beyond ASCII.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before A-Z are lowered
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WINDOW = 10
AUTOMATON_CHARS = 4_000_000  # of windows and item ids in one automaton; more windows are read in further passes


def item_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(window, n_words, items, weight): the distinct windows of all items, with the ids (as strings) of their items."""
    words = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(f"[^{SEPARATORS}]+"), F.lit(0))
    rows = (items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("words"))
            .filter(F.size("words") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))
    window = F.array_join(F.slice("words", F.col("start"), F.lit(width)), " ")
    return (rows.select("item", "words", F.explode(starts).alias("start"))
            .groupBy(window.alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))
            .withColumn("n_words", F.size(F.split("window", " ")))
            .withColumn("weight", F.length("window") + F.aggregate("items", F.lit(0), lambda n, i: n + F.length(i) + 8)))


@lru_cache(maxsize=1)
def _automaton(windows: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of (window, words, items); it gives (words, place in the list)."""
    automaton = ahocorasick.Automaton()
    for i, (window, n, _) in enumerate(windows.value):
        automaton.add_word(f" {window} ", (n, i))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def plain_words(text: str) -> list[str]:
    """The words of a text with A-Z lowered."""
    return text.encode().translate(PLAIN).decode().split(" ")


def _hits(words: list[str], automaton: ahocorasick.Automaton, hit: bytearray, found: set[int]) -> None:
    """Marks the words inside windows and adds the places of the windows."""
    starts = None
    for end, (n, i) in automaton.iter(f" {' '.join(words)} "):
        if starts is None:
            starts = list(accumulate((len(w) + 1 for w in words), initial=1))
        last = bisect_right(starts, end - 1) - 1
        hit[last - n + 1:last + 1] = b"\x01" * n
        found.add(i)


def _spans(text: str, hit: bytearray) -> list[dict]:
    """Runs of hit words as places in the original text."""
    spans, before = [], False
    for word, now in zip(ORIGINAL_WORD.finditer(text), hit):
        if now and before:
            spans[-1]["end"] = word.end()
        elif now:
            spans.append({"start": word.start(), "end": word.end()})
        before = now
    return spans


def _pass(rows: DataFrame, windows: list, last: bool) -> DataFrame:
    """One reading of ``rows`` (key, text, hit, items); the last one gives spans instead of texts."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    kind = rows.schema["key"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            counts, hits, items, spans = [], [], [], []
            for text, hit, own in zip(*(batch.column(c) for c in range(1, 4))):
                words = [w for w in plain_words(text.as_py() or "") if w]
                marks, found = bytearray(hit.as_py() or bytes(len(words))), set()
                if words and len(automaton):
                    _hits(words, automaton, marks, found)
                counts.append(len(words))
                hits.append(bytes(marks) if any(marks) else None)
                items.append(sorted({*(own.as_py() or ()), *(i for f in found for i in shared.value[f][2])}))
                if last:
                    spans.append(_spans(text.as_py(), marks) if hits[-1] else [])
            if last:
                n_hit = [sum(h) if h else 0 for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, span)], ["key", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    ["key", "text", "hit", "items"])

    if last:
        return rows.mapInArrow(run, f"key {kind}, n_words long, n_hit long, items array<string>, "
                                    "spans array<struct<start: int, end: int>>")
    return rows.mapInArrow(run, f"key {kind}, text string, hit binary, items array<string>")


def find_overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", width: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """One row per document: key, n_words, n_hit, items and spans.

    An item's windows are its runs of ``width`` consecutive words; an item of fewer words, but at least one, is one
    window.  Words are lowered in A-Z only.  ``items`` are the ids, as sorted strings, of the items with a window
    in the text; ``n_hit`` counts the words inside such windows and ``spans`` are their runs as (start, end) in
    code points of the original text.

    The windows are made by Spark, their size is measured, and windows up to ``automaton_chars`` are one automaton,
    which is sent to the tasks.  Of more windows each hash class of about that size is an automaton of its own and
    the texts are read once for each, carrying their marks; the result is the same.

    Null and empty texts have no words; repeated rows and null keys give a row each.  Items of null or
    wordless text never occur; rows with one item id are one item, and a null id is the id "".  Empty
    tables give no rows, or rows without hits.
    """
    windows = cut(item_windows(items, item, item_text, width), "benchmark-windows")
    weight = windows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    passes = max(1, -(-weight // automaton_chars))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("hit"),
                       F.lit(None).cast("array<string>").alias("items"))
    for p in range(passes):
        share = windows.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == p).select("window", "n_words", "items")
        # At most about automaton_chars, whatever the benchmark's size.
        rows = _pass(rows, [tuple(r) for r in share.collect()], last=p == passes - 1)
        if p < passes - 1:
            rows = cut(rows, "benchmark-pass")
    return rows.withColumnRenamed("key", key)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = f"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^{SEPARATORS}]+')"""
OP13_SQL = f"""
WITH item_words AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(words[s:s + {WINDOW - 1}], ' ') AS win, least(len(words), {WINDOW}) AS n
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 2))) AS s FROM item_words WHERE len(words) > 0)),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS words FROM documents),
runs AS (
  SELECT rid, n, s, array_to_string(words[s:s + n - 1], ' ') AS win FROM (
    SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS s
    FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
met AS (SELECT rid, s, r.n, r.win FROM runs r SEMI JOIN windows w ON r.win = w.win AND r.n = w.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM met) GROUP BY rid),
own AS (SELECT DISTINCT m.rid, w.item FROM (SELECT DISTINCT rid, win FROM met) m JOIN windows w ON m.win = w.win),
listed AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM own GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""
