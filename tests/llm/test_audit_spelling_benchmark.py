"""Filter audit, spelling variants and benchmark decontamination against brute force, on small and odd tables."""

import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from insidertrail.llm import decontamination, filter_audit, spelling

DOCS = "doc_id long, text string, lang string, node string, key long, items string, word string, `left` int"
CLASH = ("clash", 5, "clash", "clash", 1)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS).repartition(parts)


# --- filter interaction audit -------------------------------------------------


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def failing(text, repeated):
    words, text = words_of(text), text or ""
    upper = sum("A" <= c <= "Z" for c in text)
    return {f for f, fails in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text),
                                            bool(set(text) & set("#$%&*|")), repeated)) if fails}


def audited(docs, labels):
    """The audit by trying every order on every document."""
    least, good, toxic = {}, set(), set()
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    for key, quality, bad in labels:
        good |= {key} if quality == 1 and key is not None else set()
        toxic |= {key} if bad == 1 and key is not None else set()
    rows = {}
    fails = [(lang or "", key, failing(t, key is not None and key > least[t or ""])) for key, t, lang in docs]
    for part in {p for p, _, _ in fails}:
        mine = [(k, f) for p, k, f in fails if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                left = [(k, b) for k, b in mine if not b & set(order[:step - 1])]
                gone = [k for k, b in left if f in b]
                share[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left) - len(gone), len(gone), sum(f in b and bool(b & set(order[:step - 1])) for _, b in mine),
                    sum(b == {f} for _, b in mine), sum(k in good for k in gone), sum(k in toxic for k in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(share[order[step - 1]])
    return rows


def audit_docs(seed=1, n=90):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["Ab", "c", "#d", "EFG", str(rng.randint(0, 300))]) for _ in range(rng.choice([3, 99, 100, 140])))
            for _ in range(14)] + [" ".join(str(i) for i in range(120)), "", None, "|", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90]
    rows = [(rng.randint(0, 60), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(n)]
    return rows + [(None, pool[0], "en"), (None, pool[0], "en"), (70, "x " * 50_000, "en"), *rows[:3]]


LABELS = [(k, k % 3, k % 2) for k in range(0, 60, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1)]


def audit_rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def test_audit_equals_every_order_tried(spark, tmp_path):
    docs = audit_docs()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    # Files in falling order of ids: smaller ids of a text come last and take masks back.
    for i, rows in enumerate([docs[60:], docs[:60]]):
        for j, half in enumerate((sorted(rows, key=lambda r: -(r[0] or 0))[:40], sorted(rows, key=lambda r: -(r[0] or 0))[40:])):
            frame(spark, half, 1).write.mode("append").parquet(f"{tmp_path}/in")
    got = audit_rows(filter_audit.filter_audit(spark, f"{tmp_path}/in", labels, batches=4))
    assert got == audited(docs, LABELS)


def test_audit_goes_on_where_it_stopped(spark, tmp_path):
    docs = audit_docs(seed=5)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    late = sorted(docs, key=lambda r: (r[0] is None, r[0]))
    for rows in (late[45:], late[:45]):
        frame(spark, rows, 2).write.mode("append").parquet(f"{tmp_path}/in")
        got = filter_audit.filter_audit(spark, f"{tmp_path}/in", labels, folder=f"{tmp_path}/state")
    assert audit_rows(got) == audited(docs, LABELS)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    for name, schema in (("state", filter_audit.STATE), ("changes", filter_audit.COUNTED)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}/batch_id=-1")
    handle = filter_audit._settle(str(tmp_path), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), 16)
    kind = "key long, part string, digest binary, mask int"
    later = spark.createDataFrame([(5, "en", b"x", 1), (7, "en", b"x", 1), (7, "de", b"y", 2)], kind)
    sooner = spark.createDataFrame([(3, "en", b"x", 1), (7, "de", b"y", 2), (None, "de", b"y", 2)], kind)
    for batch, number in ((later, 0), (later, 0), (sooner, 1), (sooner, 1), (later.limit(0), 2)):
        handle(batch, number)
    sums = spark.read.parquet(f"{tmp_path}/changes").groupBy("part", "mask").agg(F.sum("delta").alias("n")).filter("n <> 0")
    assert {tuple(r) for r in sums.collect()} == {("en", 1, 1), ("en", 17, 2), ("de", 2, 3)}


def test_audit_of_nothing(spark, tmp_path):
    frame(spark, [], 1).write.parquet(f"{tmp_path}/in")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark, f"{tmp_path}/in", labels).count() == 0


# --- spelling variants ---------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def grouped(counts, ratio=2):
    rows = {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        rows[word] = [n, len(others), best if best and counts[best] >= ratio * n else None]
    out = set()
    for word, (n, count, form) in rows.items():
        root = word
        while rows[root][2]:
            root = rows[root][2]
        out.add((word, n, count, form, counts.get(form), root))
    return out


def vocabulary(seed=3):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé÷") for _ in range(rng.randint(5, 10))) for _ in range(500)}
    words |= {w[:3] + w[4:] for w in words if len(w) > 5}
    long = "".join(rng.choice("abcd") for _ in range(300))
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "b" * 7, "b" * 8, "b" * 9, "b" * 10, "b" * 7 + "c", "b" * 8 + "c", "c" + "b" * 8}
    words |= {long, long[:200] + long[201:], long[:50] + "e" + long[51:], long[:50] + "f" + long[51:], long[:299], "z" + long, long[:10] + long[12:]}
    return {w: rng.randint(3, 60) for w in words}


@pytest.mark.parametrize("most", [spelling.BROADCAST_ROWS, 0])
def test_variants_equal_all_pairs(spark, most):
    counts = vocabulary()
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most, trie_length=8)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == grouped(counts)
    assert got.count() == len(counts)


def counted(rows):
    seen = {}
    for key, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] = seen.get(run, 0) + 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def test_words_are_counted_and_damaged(spark):
    rng = random.Random(9)
    pool = ["Größe", "straße", "ÀÉÎÕÜ", "Letter", "LETTERS", "l'étoile", "x×y÷zabc", "ab", "İstanbul", "naïveté", "日本語letter"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60)), "en") for i in range(40)]
    rows += [(None, "nullkey nullkey nullkey", "en"), (3, None, None), (4, "", ""), (5, " \t\n", "en"), rows[0], rows[0], (6, "q" * 20_000, "en")]
    rows += [(7, "q" * 20_000, "en"), (8, "q" * 20_000, "en")]
    want = counted(rows)
    docs = frame(spark, rows)
    assert {(r.word, r.n) for r in spelling.word_counts(docs).collect()} == set(want.items())
    assert any(w in want for w in ("leter", "lettrs", "lettes", "etters", "trasse", "letters"[1:], "ettrs")) or len(want) > 8
    got = spelling.variants(spelling.word_counts(docs))
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == grouped(want)


def test_no_words_no_variants(spark):
    assert spelling.variants(spelling.word_counts(frame(spark, []))).count() == 0
    assert spelling.variants(spelling.word_counts(frame(spark, [(1, "one two", "en"), (2, None, None)]))).count() == 0


# --- benchmark decontamination --------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def overlaps(docs, items, width=10):
    windows = {}
    for item, text in items:
        words = item_words(text)
        for s in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[s:s + width]), set()).add("" if item is None else str(item))
    out = []
    for key, text, _ in docs:
        words, hit, found = item_words(text), set(), set()
        for window, ids in windows.items():
            for s in range(len(words) - len(window) + 1):
                if tuple(words[s:s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= ids
        out.append((key, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "What is the Name of the river that flows past the old town of Wessel?"), (2, "short One"), (3, None), (4, " .,;: "),
         (10, "what is the name of the river that flows past the new town"), (None, "nameless item here"), (2, "short one again"),
         (5, "één twee drie vier vijf zes zeven acht negen tien elf"), (6, "a a a a a a a a a a a a"), (7, "short")]


def benchmark_docs():
    river, rng = ITEMS[0][1], random.Random(2)
    rows = [(1, "Lead in. " + river.upper() + " And more.", "en"), (2, river[:40], "en"), (3, "x\x00y" + river.replace(" ", " -- "), "en"),
            (4, None, None), (5, "", "en"), (6, "ÉÉN één twee drie", "nl"), (7, "één, Twee drie vier vijf zes zeven acht negen tien elf", "nl"),
            (8, "a " * 500, "en"), (9, "A SHORT one; shorter", "en"), (None, "nameless item here", "en"), (None, None, None),
            (11, "so short-one", "en"), (12, "z" * 30_000 + " short", "en")]
    rows += [(20 + i, " ".join(rng.choice(["short", "one", "again", "a", "what", "é"]) for _ in range(40)), "en") for i in range(20)]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("chars", [decontamination.AUTOMATON_CHARS, 150])
def test_overlaps_equal_brute_force(spark, chars):
    docs = benchmark_docs()
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, words string").repartition(2)
    found = decontamination.find_overlaps(frame(spark, docs), items, automaton_chars=chars)
    rows = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str) == overlaps(docs, ITEMS)
    for r in rows:  # spans are places in the original text, over exactly the hit words
        text = next(t or "" for k, t, _ in docs if k == r.doc_id and (k is not None or bool(t) == bool(r.n_words)))
        assert sum(len(item_words(text[s.start:s.end])) for s in r.spans) == r.n_hit
        assert all(text[s.start:s.end].strip(" .,;:-?") == text[s.start:s.end] for s in r.spans)


def test_empty_benchmark_and_empty_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = benchmark_docs()
    got = decontamination.find_overlaps(frame(spark, docs), none)
    assert got.count() == len(docs) and got.filter("n_hit > 0 or size(items) > 0").isEmpty()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_overlaps(frame(spark, []), items).count() == 0
    null_items = items.withColumn("text", F.lit(None).cast("string"))
    assert decontamination.find_overlaps(frame(spark, docs), null_items).filter("n_hit > 0").isEmpty()
