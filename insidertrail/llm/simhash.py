"""SimHash near-duplicates by anchor points: fingerprints meet at the codewords of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insidertrail.llm.common import BROADCAST_ROWS, cut, discard, released, table
from insidertrail.llm.components import connected_components

SEED = 42
# The binary Golay code of 23 bits (generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1) is perfect:
# every word lies within 3 bits of exactly one codeword.
GOLAY_BITS, GOLAY_CHECKS, GOLAY_POLYNOMIAL, GOLAY_RADIUS = 23, 11, 0b101011100011, 3
HASHES_AT_ONCE = 255  # so that counts of bits fit a byte
# Similar documents: shingles that repeat in one document of so many tell which are frequent, at most so many of them.
SAMPLE, FREQUENT = 16, 500_000
FILTER_BITS = 26  # of the filter of texts that take part in a pair; it may let others pass
ROWS_AT_ONCE = 1000
PARITIES = 1024  # least number of bits that tell the parity of the shingles of a set that fall on each
HUB_TURNS = 1


def shingle_hashes(words: list[bytes], width: int) -> Iterator[int]:
    """XXH64 of each run of ``width`` words, space-joined; of all words where they are fewer."""
    runs = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return map(xxhash.xxh64_intdigest, runs, repeat(SEED))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at the six ASCII white spaces


def majority(hashes: Iterator[int], n: int, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words, each bit set in over half of the ``n`` hashes; later words mix the hash again."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        some = np.fromiter(hashes, "<u8", min(HASHES_AT_ONCE, n - at))
        mixed = np.empty((len(some), words), "<u8")
        for w in range(words):
            mixed[:, w] = some
            # The finaliser of splitmix64 gives each word bits of its own.
            some = some + np.uint64(0x9E3779B97F4A7C15)
            some = (some ^ some >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            some = (some ^ some >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            some = some ^ some >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each the majority (over half) of that bit among the hashes of the text's word shingles."""
    words = words_of(text)
    return int(majority(shingle_hashes(words, width), max(1, len(words) - width + 1))[0]) if words else 0


def _prints(texts: list[str | None], width: int) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t, width) for t in texts), "<u8", len(texts)).view("<i8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed long; 0 for null texts and texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _prints(batch.column(1).to_pylist(), width)], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"key {rows.schema['key'].dataType.simpleString()}, fp long")


@cache
def _reach(most: int):
    """Per syndrome, the error patterns of at most ``most`` bits with their weights: (starts, patterns, weights)."""
    def syndrome(word: int) -> int:
        for bit in range(GOLAY_BITS - 1, GOLAY_CHECKS - 1, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - GOLAY_CHECKS)
        return word

    single = [syndrome(1 << i) for i in range(GOLAY_BITS)]
    rows = []
    for weight in range(most + 1):
        for bits in combinations(range(GOLAY_BITS), weight):
            s = p = 0
            for b in bits:
                s, p = s ^ single[b], p | 1 << b
            rows.append((s, p, weight))
    table_ = np.array(rows, np.int64)
    table_ = table_[np.argsort(table_[:, 0], kind="stable")]
    starts = np.searchsorted(table_[:, 0], np.arange((1 << GOLAY_CHECKS) + 1))
    return starts, table_[:, 1].copy(), table_[:, 2].copy(), np.array(single, np.int64)


def _syndromes(words: np.ndarray, single: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i in range(GOLAY_BITS):
        out ^= np.where(words >> i & 1, single[i], 0)
    return out


def anchors_around(fps: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors near each fingerprint.

    An anchor is a pair of Golay codewords for bits 0-22 and 23-45; the other 18 bits are free.  Its
    covering radius is 3 in each half.  Listed are the anchors whose distances exceed that by at most
    ``extra`` bits in both halves together; with ``extra`` 0 it is the one anchor that covers the row.
    """
    starts, patterns, weights, single = _reach(GOLAY_RADIUS + extra)
    mask = (1 << GOLAY_BITS) - 1
    words = fps.view("<u8")
    halves = [(words & np.uint64(mask)).astype(np.int64), (words >> np.uint64(GOLAY_BITS) & np.uint64(mask)).astype(np.int64)]

    def near(half: np.ndarray, rows: np.ndarray):
        s = _syndromes(half, single)[rows]
        n = starts[s + 1] - starts[s]
        at = np.repeat(starts[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who = np.repeat(np.arange(len(rows)), n)
        return who, half[rows][who] ^ patterns[at], np.maximum(weights[at] - GOLAY_RADIUS, 0)

    rows = np.arange(len(fps))
    first, word_a, over_a = near(halves[0], rows)
    second, word_b, over_b = near(halves[1], first)
    keep = over_a[second] + over_b <= extra
    second, word_b = second[keep], word_b[keep]
    return first[second], word_a[second] << GOLAY_BITS | word_b


def anchored(rows: DataFrame, extra: int) -> DataFrame:
    """``rows`` (tag, fp, id), each once with every anchor near its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                row, anchor = anchors_around(some.column(1).to_numpy(zero_copy_only=False), extra)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *some.take(pa.array(row)).columns], ["anchor", "tag", "fp", "id"])

    return rows.select("tag", "fp", "id").mapInArrow(released(run), "anchor long, tag int, fp long, id long")


def linked_fingerprints(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ids of all pairs of ``rows`` (tag, fp, id) with one tag whose fingerprints differ in 1 to ``threshold`` bits.

    Each tag has a fingerprint once.  Every fingerprint is at home at the anchor that covers it and
    visits all anchors within covering radius plus threshold.  A fingerprint within the threshold of another
    can be no farther from the other's home, so each pair meets where its smaller member is at home.
    A fingerprint has a bounded number of others so near, so links stay in proportion to fingerprints.
    Fingerprints one bit apart have different parity: for threshold 1 the odd ones stay at home and only the
    even ones visit.
    """
    at_home = visiting = rows
    near = (F.col("home_fp") < F.col("fp")) & (F.bit_count(F.col("home_fp").bitwiseXOR(F.col("fp"))) <= threshold)
    if threshold == 1:
        at_home, visiting = (rows.filter(F.bit_count("fp") % 2 == parity) for parity in (1, 0))
        near = F.bit_count(F.col("home_fp").bitwiseXOR(F.col("fp"))) == 1
    home = anchored(at_home, 0).select("anchor", "tag", F.col("fp").alias("home_fp"), F.col("id").alias("a"))
    visits = anchored(visiting, threshold).select("anchor", "tag", "fp", F.col("id").alias("b"))
    return visits.join(home.hint("shuffle_hash"), ["anchor", "tag"]).filter(near).select("a", "b")


def labelled(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``nodes`` (id, least, ...) plus component_id, the smallest ``least`` in the component of ``groups`` (node, component)."""
    found = nodes.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    leasts = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return cut(found.join(leasts, "component").drop("component"), "simhash-labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
                    threshold: int = 2) -> DataFrame:
    """One row per document: key, fp (signed long) and component_id, the smallest key reachable over links.

    Documents link when their fingerprints differ in at most ``threshold`` bits; equal fingerprints are one
    node, so copies are never paired.  Null texts and texts without words have fingerprint zero and link
    like any other.  Repeated rows give a row each; null keys are passed over when the smallest key is
    chosen, which is null where a component has no other.  An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, key, text, width), "simhash-fps")
    nodes = cut(marked.groupBy("fp").agg(F.min("key").alias("least")).withColumn("id", F.col("fp")), "simhash-nodes")
    edges = cut(linked_fingerprints(nodes.withColumn("tag", F.lit(0)), threshold), "simhash-links")
    labels = labelled(nodes, connected_components(edges))
    return marked.join(labels.select("fp", "component_id"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct digests of the text's word shingles, ascending; none for null texts and texts without words."""
    words = words_of(text)
    return np.unique(np.fromiter(shingle_hashes(words, width), "<u8")) if words else np.zeros(0, "<u8")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view("<i8")))


def shingle_sets(docs: DataFrame, width: int, first, columns: str, passing: Broadcast | None = None, whole=None) -> DataFrame:
    """``docs`` (key, text, digest) with ``columns``: those of ``first``, a function of a list of shingle sets to arrays,
    then those of ``whole``, if given: the same of a list of texts.

    ``passing`` are words of bits; rows whose digest has no bit set there are left out before they are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if passing is not None:
                at = batch.column(2).to_numpy(zero_copy_only=False).view("<u8") & np.uint64((1 << FILTER_BITS) - 1)
                batch = batch.filter(pa.array((passing.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                texts = some.column(1).to_pylist()
                found = first([shingle_set(t, width) for t in texts]) + (whole(texts) if whole else [])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *found], names)

    names = ["key", "digest"] + [c.split()[0] for c in columns.split(", ")]
    return docs.mapInArrow(released(run), f"key {docs.schema['key'].dataType.simpleString()}, digest long, {columns}")


def _ids(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "<u8").view("<i8"))


def _parities(sets: list[np.ndarray]) -> pa.Array:
    """Per set, the parities of the shingles that fall on each of at least twice as many bits, a power of two."""
    out = []
    for s in sets:
        bits = max(PARITIES, 1 << (2 * len(s) - 1).bit_length()) if len(s) else PARITIES
        out.append(np.packbits((np.bincount((s % bits).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view("<u8"))
    return _lists(out)


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles most often met in one document of ``SAMPLE``, ascending, with their counts.

    They only decide which shingles of a document come last; any choice finds the same pairs.
    """
    some = shingle_sets(docs.filter(F.pmod("digest", F.lit(SAMPLE)) == 0), width, lambda sets: [_lists(sets)], "shingles array<long>")
    counts = (some.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
              .filter("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow())
    found, n = (counts.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(found.view("<u8"))
    return found.view("<u8")[order], n[order]


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(shingle, id, size, at): the first shingles of ``nodes`` (id, size, first) that more than one of them has.

    Rows are shuffled once; what a shingle's rows need is sorted and can spill.
    """
    rows = nodes.select("id", "size", F.posexplode("first").alias("at", "shingle"))
    return (rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("n > 1")
            .select("shingle", "id", "size", "at"))


def _oriented(rows: DataFrame, nodes: DataFrame, share: Fraction) -> DataFrame:
    """(a, b), b the smaller, once each: those of ``rows`` (x and y, each id, size and at, of one shared shingle) that may be similar.

    Similar sets share a shingle that in both stands so early that enough can follow; the smaller one has it among
    as many as it could miss of one of its own size, and sizes lie within ``share`` of each other.  Sets differ in at
    least as many shingles as their parities do in bits; those of the larger set are folded to the length of the other's.
    """
    num, den = share.numerator, share.denominator
    order = F.struct("x.size", "x.id") < F.struct("y.size", "y.id")
    a, b = F.when(order, F.col("y")).otherwise(F.col("x")), F.when(order, F.col("x")).otherwise(F.col("y"))
    both = rows.select(a.alias("a"), b.alias("b"))
    sizes = F.col("a.size") + F.col("b.size")
    misses = F.col("b.size") - F.ceil(2 * num * F.col("b.size") / F.lit(num + den) - F.lit(1e-9))
    near = ((den * F.col("b.size") >= num * F.col("a.size")) & (F.col("b.at") <= misses) & (F.col("a.id") != F.col("b.id"))
            & ((num + den) * F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= num * sizes))
    pairs = both.filter(near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    one, other = (nodes.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("parities").alias(f"bits_{c}")) for c in "ab")
    words = F.least(F.size("bits_a"), F.size("bits_b"))

    def folded(bits: str) -> Column:
        halves = F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(bits) > words, halves).otherwise(F.col(bits))

    apart = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = (num + den) * apart <= (den - num) * (F.col("size_a") + F.col("size_b"))
    return pairs.join(one, "a").join(other, "b").filter(alike).select("a", "b")


def _with_groups(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """``shared`` with the component of each node from ``groups`` (node, component); shingles whose nodes are all in one are left out.

    So are those where every node stood for a group of its own (``with_picks``): all their pairs are known.
    """
    groups = groups.withColumnRenamed("node", "id")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    rows = shared.drop("group").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    of_shingle = Window.partitionBy("shingle")
    mixed = rows.withColumns({"least": F.min("group").over(of_shingle), "most": F.max("group").over(of_shingle)}).filter("least <> most")
    if "picked" in shared.columns:
        mixed = mixed.withColumn("all", F.bool_and("picked").over(of_shingle)).filter("not all").drop("all")
    mixed = cut(mixed.drop("component", "least", "most"), "simhash-mixed")
    discard(shared)
    return mixed


POINT = ("id", "size", "at", "group")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(x, y): each shingle's nodes against one of them, its hub: the one with the fewest rarer shingles.

    Of a text's edited copies that is the one with the fewest changes, the one that most others are similar to; it is hub
    of as many of its shingles as may be.  The group so gives one star, not a pair for any two of its members.
    """
    hubs = shared.groupBy("shingle").agg(F.min(F.struct(F.col("at").alias("rarer"), F.xxhash64("id").alias("h"), *POINT)).alias("hub"))
    hubs = hubs.select("shingle", F.struct(*[F.col(f"hub.{c}").alias(c) for c in POINT]).alias("x"))
    met = shared.select("shingle", F.struct(*POINT).alias("y")).join(hubs, "shingle")
    return met.filter(F.col("x.group") != F.col("y.group")).select("x", "y")


def with_picks(shared: DataFrame) -> DataFrame:
    """``shared`` with ``picked``: whether a node stands for its group among the nodes of the shingle, having the fewest rarer ones."""
    of_group = Window.partitionBy("shingle", "group").orderBy("at", F.xxhash64("id"), "id")
    return cut(shared.withColumn("picked", F.row_number().over(of_group) == 1), "simhash-picked")


def picked_pairs(shared: DataFrame) -> DataFrame:
    """(x, y): of any two groups that have nodes of a shingle, the two nodes that stand for them there."""
    rows = shared.filter("picked")
    one, other = (rows.select("shingle", F.struct(*POINT).alias(c)) for c in "xy")
    return one.join(other, "shingle").filter(F.col("x.id") < F.col("y.id")).select("x", "y")


def rest_pairs(shared: DataFrame) -> DataFrame:
    """(x, y): all pairs of a shingle's nodes that are in different groups, but for those of ``picked_pairs``.

    Of two such nodes at least one is outside the shingle's largest group, so only those nodes meet the others.
    """
    groups = shared.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = groups.groupBy("shingle").agg(F.max(F.struct("n", "group"))["group"].alias("largest"))
    point = F.struct(*POINT, "picked")
    outside = shared.join(largest, "shingle").filter("group <> largest").select("shingle", point.alias("x"))
    met = shared.select("shingle", point.alias("y")).join(outside, "shingle")
    return met.filter((F.col("x.group") != F.col("y.group")) & ~(F.col("x.picked") & F.col("y.picked"))).select("x", "y")


def similar_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``share`` or more.

    Only texts of these pairs are read into sets: their digests set bits of a filter of fixed size.
    """
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    low = F.col("digest").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (nodes.join(wanted, "id").groupBy(F.shiftright(low, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(digest & 63 as int))")).alias("bits")).toArrow())
    passing = np.zeros(1 << FILTER_BITS - 6, "<u8")
    passing[words.column("word").to_numpy()] = words.column("bits").to_numpy().view("<u8")
    passing = docs.sparkSession.sparkContext.broadcast(passing)  # 8 MB, whatever the number of pairs
    sets = shingle_sets(docs, width, lambda sets: [_ids(sets), _lists(sets)], "id long, shingles array<long>", passing)
    sets = cut(sets.groupBy("id").agg(F.any_value("shingles").alias("shingles")), "simhash-sets")
    one, other = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    found = cut(pairs.join(one, "a").join(other, "b")
                .filter(share.denominator * both >= share.numerator * either).select("a", "b"), "simhash-similar")
    discard(sets)
    return found


def fingerprint_links(prints: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ids of ``prints`` (id, fp) linked so that all within ``threshold`` bits of one another, step by step, are joined.

    One id stands for each fingerprint: the others with it link to that one, and fingerprints link by theirs.
    """
    prints = cut(prints.distinct(), "simhash-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    equal = prints.join(nodes.withColumnRenamed("id", "a"), "fp").filter("a <> id").select("a", F.col("id").alias("b"))
    return linked_fingerprints(nodes.withColumn("tag", F.lit(0)), threshold).unionByName(equal)


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                      similarity: float = 0.8, threshold: int | None = None, print_width: int = 3) -> DataFrame:
    """One row per document: key and component_id, the smallest key reachable over links of similar documents.

    Documents link when the sets of their ``width``-word shingles have a Jaccard similarity of at least
    ``similarity``; every such pair is found.  With ``threshold`` they also link as in ``near_duplicates``, when their
    fingerprints (of ``print_width``-word shingles) differ in at most so many bits; these links come first, and pairs
    that they have joined are not looked at again.  A single 64-bit fingerprint tells similar documents about ten bits
    apart, too far for any covering code, so the others meet at their rarest shingles and the sets decide.  Documents with
    equal sets are one node, whose id is the digest of the set.  First a shingle's nodes are held against one of them,
    in ``HUB_TURNS`` turns; then any two groups that this has left by a node of each; then every pair
    that is still not in one group is looked at.
    Large groups of similar texts so cost a few comparisons per member, and no pair is missed.
    Null texts and texts without words are one group; keys and repeated rows as in ``near_duplicates``.
    """
    share = Fraction(str(similarity))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, width))

    def first(sets: list[np.ndarray]) -> list[pa.Array]:
        lists, (common, counts) = [], frequent.value
        for s in sets:
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
            lists.append(s[:len(s) + 1 - -(-share.numerator * len(s) // share.denominator)] if len(s) else s)
        return [_ids(sets), pa.array([len(s) for s in sets], pa.int32()), _lists(lists), _parities(sets)]

    columns, whole = "id long, size int, first array<long>, parities array<long>", None
    if threshold is not None:
        columns, whole = columns + ", fp long", lambda texts: [_prints(texts, print_width)]
    marked = cut(shingle_sets(rows, width, first, columns, whole=whole).withColumn("row", F.monotonically_increasing_id()), "simhash-marked")
    members = cut(marked.select("key", "id"), "simhash-members")
    groups = docs.sparkSession.createDataFrame([], "node long, component long")
    if threshold is not None:
        groups = cut(connected_components(fingerprint_links(marked.select("id", "fp"), threshold)), "simhash-groups")
    # The narrow columns of copies are folded first; the wide ones come from one row of each node.
    narrow = cut(marked.groupBy("id").agg(F.min("key").alias("least"), F.min("digest").alias("digest"), F.min("row").alias("row")), "simhash-narrow")
    ones = marked.select("row", "id", "size", "first", "parities").join(narrow.select("row"), "row", "left_semi")
    shared = cut(shared_shingles(ones.select("id", "size", "first")).withColumn("group", F.col("id")), "simhash-shared")
    nodes = cut(ones.select("id", "size", "parities").join(narrow.select("id", "least", "digest"), "id"), "simhash-nodes")
    discard(marked, narrow)
    if threshold is not None:
        shared = _with_groups(shared, groups)
    seen = []
    for turn in range(HUB_TURNS + 2):
        if turn < HUB_TURNS:
            met = hub_pairs(shared)
        elif turn == HUB_TURNS:
            shared = with_picks(shared)
            met = picked_pairs(shared)
        else:
            met = rest_pairs(shared)
        pairs = _oriented(met, nodes, share)
        for earlier in seen:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        seen.append(cut(pairs, "simhash-pairs"))
        if not seen[-1].isEmpty():
            # Earlier groups are stars by now: only the new links make rounds.
            stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            links = similar_pairs(seen[-1], rows, nodes, width, share).unionByName(stars)
            groups = cut(connected_components(links), "simhash-groups")
        if turn <= HUB_TURNS:
            shared = _with_groups(shared, groups)
    discard(shared)
    labels = labelled(nodes.select("id", "least"), groups)
    discard(nodes)
    return members.join(labels, "id").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=near_duplicates, **options) -> DataFrame:
    """The document with the smallest key of each group that ``find`` forms, with all its columns.

    Of repeated rows with that key one stays, the first by the hash of the whole row.  Rows with a null key
    cannot be told from one another and all stay.
    """
    found = find(docs, key, text, **options)
    kept = (found.filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("__kept"))
            .agg(F.count(F.lit(1)).alias("__rows")))
    rows = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__id"))
    joined = rows.filter("__id is not null").join(cut(kept, "simhash-kept"), F.col("__id") == F.col("__kept"))
    order = Window.partitionBy("__id").orderBy(F.xxhash64("__row"))
    repeated = (joined.filter("__rows > 1").withColumn("__n", F.row_number().over(order)).filter("__n = 1"))
    return (joined.filter("__rows = 1").select("__row").unionByName(repeated.select("__row"))
            .unionByName(rows.filter("__id is null").select("__row")).select("__row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
