"""Spelling variant grouping: words walk a trie held as an edge table, level by level, with one edit to spend."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import BROADCAST_ROWS, ascii_lower, cut, table

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
DAMAGED_EVERY = 97
# Words up to this length walk the trie; sets of the lengths below a node fit the bits of a long.
TRIE_LENGTH = 62
SALTS = 8
PRIME, BASE = (1 << 61) - 1, 1_000_003


def char(word: Column, at: Column) -> Column:
    """The code point at a 0-based place."""
    return F.substring(word, at + 1, F.lit(1))


def letter_bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(letter), F.lit(64)))


def length_bit(length: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), length)


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, letter, lengths, letters), one row per edge of the trie of ``words`` (word).

    A node is its prefix.  ``lengths`` are the lengths of the rests of words below the edge, as bits (bit 0: a
    word ends there), ``letters`` the letters that follow it.  Both only rule states out.
    """
    at = F.col("depth")
    rest = F.length("word") - at - 1
    rows = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("depth"))
    return (rows.select("depth", F.substring("word", F.lit(1), at).alias("node"), char(F.col("word"), at).alias("letter"),
                        length_bit(rest).alias("length"), F.when(rest > 0, letter_bit(char(F.col("word"), at + 1))).alias("next"))
            .groupBy("depth", "node", "letter")
            .agg(F.bit_or("length").alias("lengths"), F.coalesce(F.bit_or("next"), F.lit(0).cast("long")).alias("letters")))


def _met(states: DataFrame, edges: DataFrame, n_edges: int, keys: list[str], most: int) -> DataFrame:
    """``states`` joined to a level's ``edges``: sent to all tasks when counted small, else with every key split by word.

    A node has at most one edge per letter, so a popular prefix is a matter of its states alone, which are dealt
    over ``SALTS`` copies of its edges.
    """
    if n_edges <= most:
        return states.join(F.broadcast(edges), keys)
    copies = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = states.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def _trie_pairs(words: DataFrame, most: int) -> DataFrame:
    """(word, other): of each pair of ``words`` (word) one edit apart at least one order, by the trie frontier.

    States are (word, at, node, edits).  States without an edit are the word's own prefixes.  One edit deletes the
    word's next letter or replaces it by a larger one, so of two words the one with the smaller letter, or the
    longer one, finds the other.  States with an edit then follow the word's letters along the edges.  A state
    that has used up the word at the end of another is a pair.
    """
    spark = words.sparkSession
    edges = cut(trie_edges(words), "spelling-edges")
    levels = dict(edges.groupBy("depth").count().collect())  # at most TRIE_LENGTH rows
    walked = []  # the written states of each level
    for depth in range(max(levels, default=-1) + 1):
        own = edges.filter(F.col("depth") == depth).drop("depth")
        word, letter, length = F.col("word"), F.col("letter"), F.length("word")
        rest = length - F.col("at")
        alive = ((F.call_function("shiftright", F.col("lengths"), rest.cast("int")).bitwiseAND(F.lit(1)) == 1)
                 & ((rest == 0) | (F.col("letters").bitwiseAND(letter_bit(char(word, F.col("at")))) != 0)))
        node = F.concat("node", "letter").alias("node")
        # The first edit, at the word's own prefix of this depth.
        prefixes = words.filter(length > depth).select("word", F.substring("word", 1, depth).alias("node"))
        branched = _met(prefixes, own, levels[depth], ["node"], most)
        here, following = char(word, F.lit(depth)), char(word, F.lit(depth + 1))
        places = F.array_compact(F.array(
            F.when(letter > here, F.lit(depth + 1)),  # replaced
            F.when((length > depth + 1) & (letter == following), F.lit(depth + 2)),  # deleted, and the next one met
            F.when((length == depth + 2) & (letter == here), F.lit(depth + 2))))  # the last one deleted
        edited = branched.select("word", F.explode(places).alias("at"), node, "lengths", "letters").filter(alive)
        steps = [edited.select("word", "at", "node")]
        if walked:
            front = walked[-1].filter(F.col("at") < length).withColumn("letter", char(word, F.col("at")))
            steps.append(_met(front, own, levels[depth], ["node", "letter"], most)
                         .select("word", (F.col("at") + 1).alias("at"), node, "lengths", "letters").filter(alive)
                         .select("word", "at", "node"))
        states = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        walked.append(cut(states, f"spelling-level-{depth}"))
    ends = [s.filter(F.col("at") == F.length("word")).select("word", F.col("node").alias("other")) for s in walked]
    found = spark.createDataFrame([], "word string, other string") if not ends else ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    return found


def _deletion_keys(words: DataFrame) -> DataFrame:
    """(key, length, at, id) of each word and of its forms with one letter less; ``at`` is -1 for the word itself."""

    def forms(word: str) -> Iterator[tuple[int, int]]:
        codes, before, n = [ord(c) for c in word], [0], len(word)
        for c in codes:
            before.append((before[-1] * BASE + c) % PRIME)
        yield before[-1], -1
        after, power = 0, 1  # the digest of the letters behind, and BASE to their number
        for at in range(n - 1, -1, -1):
            yield (before[at] * power + after) % PRIME, at
            after, power = (codes[at] * power + after) % PRIME, power * BASE % PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, name in zip(*(c.to_pylist() for c in batch.columns)):
                keys, places = zip(*forms(word))
                lengths = [len(word) - (at >= 0) for at in places]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lengths, pa.int32()), pa.array(places, pa.int32()),
                                                  pa.array([name] * len(keys), pa.string())], ["key", "length", "at", "id"])

    return words.select("word", "id").mapInArrow(run, "key long, length int, at int, id string")


def _long_pairs(words: DataFrame, trie_length: int) -> DataFrame:
    """(word, other): pairs of ``words`` one edit apart of which one is too long for the trie.

    Such words meet at equal digests of what one of them is without a letter: a replacement at the same
    place, a deletion at the other word itself.  Words that agree but for one given place differ there, so each meeting
    has at most one member per letter.  Digests only propose; the words decide.
    """
    named = cut(words.withColumn("id", F.sha2("word", 256)), "spelling-long")
    keys = cut(_deletion_keys(named), "spelling-keys")
    cuts, whole = keys.filter("at >= 0"), keys.filter("at < 0")
    left, right = (cuts.select("key", "length", "at", F.col("id").alias(c)) for c in ("a", "b"))
    replaced = left.join(right, ["key", "length", "at"]).filter("a < b").select("a", "b")
    deleted = (cuts.select("key", "length", F.col("id").alias("a")).distinct()
               .join(whole.select("key", "length", F.col("id").alias("b")), ["key", "length"]).select("a", "b"))
    texts = [named.select(F.col("id").alias(c), F.col("word").alias(n)) for c, n in (("a", "word"), ("b", "other"))]
    return (replaced.unionByName(deleted).distinct().join(texts[0], "a").join(texts[1], "b").select("word", "other")
            .filter(F.greatest(F.length("word"), F.length("other")) > trie_length)
            .filter(F.levenshtein("word", "other", 1) == 1))


def near_words(words: DataFrame, most: int = BROADCAST_ROWS, trie_length: int = TRIE_LENGTH) -> DataFrame:
    """(word, other), both ways and once each: the pairs of distinct ``words`` (word) exactly one edit apart.

    An edit inserts, deletes or replaces one code point.  A level of the trie with at most ``most`` edges is broadcast;
    pairs with a word of more than ``trie_length`` (at most 62) code points are found without the trie.
    """
    words = words.select("word").filter("word <> ''")
    found = _trie_pairs(words.filter(F.length("word") <= trie_length), most)
    long = words.filter(F.length("word") >= trie_length)
    if not long.filter(F.length("word") > trie_length).isEmpty():
        found = found.unionByName(_long_pairs(long, trie_length))
    both = F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"))))
    return found.select(both.alias("pair")).select("pair.*").distinct()


def variants(counts: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word of ``counts`` (word, n; a word once).

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that n is at
    least ``ratio`` (over 1) times its own.  ``root`` follows forms to the last.  Counts at least double from form to
    form, so chains are short; they are followed by doubling, each round a join by word.  ``options`` are those of ``near_words``.
    """
    counts = cut(counts, "spelling-words")
    pairs = near_words(counts, **options)
    best = (pairs.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best")))
    larger = -F.col("best.col1") >= ratio * F.col("n")
    rows = cut(counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(larger, F.col("best.other")).alias("form"),
        F.when(larger, -F.col("best.col1")).alias("form_n")), "spelling-forms")
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(links.join(further, "root", "left"), "spelling-roots")
        links = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            break
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = RUN, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, damaged_every: int = DAMAGED_EVERY) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points met at least ``min_count`` times in all texts.

    Words are the runs of ``pattern`` with A-Z lowered.  With h the crc32 of ``<key>:<run>``, runs whose h is divided
    by ``damaged_every`` (0: none) lose the code point at h modulo their length.  Null texts have no words, a null
    key counts as "", repeated rows count again.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                       F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("run"))
    if damaged_every:
        h, length = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")), F.length("run")
        runs = runs.select("run", h.alias("h"), length.alias("length"))
        at = F.pmod("h", "length").cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length")))
        runs = runs.select(F.when(F.col("h") % damaged_every == 0, less).otherwise(F.col("run")).alias("run"))
    return (runs.filter(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))


OP12_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes
  FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, len(bytes) // 2),
      lambda i: CAST('0x' || bytes[2 * i + 1:2 * i + 2] AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM once, crc_table),
seen AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= {MIN_LENGTH} GROUP BY word
  HAVING sum(n) >= {MIN_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS part
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
         CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT k.word, f.form, step + 1 FROM walk k JOIN forms f ON k.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root
FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) r ON f.word = r.word
"""
