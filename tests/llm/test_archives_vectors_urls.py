"""WARC archives, vector searches and URL filters against brute force, on small and odd tables."""

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from insidertrail.llm import exact_search, hnsw, url_filter, vectors, warc
from insidertrail.llm.common import cut, work_path

# --- WARC -------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, size string"


def page_rows():
    same = "<p>é same</p>"
    return [(i, u, h, "clash", "clash") for i, u, h in [
        (5, "http://a.example/x y\r\nInjected: 1", same), (3, "http://b.example/", same), (9, None, same), (1, "http://c.example/", None),
        (2, "http://d.example/", ""), (7, "http://e.example/", "alone"), (None, "http://f.example/", same), (None, None, "keyless"),
        (11, "http://g.example/", "<br>\r\n\r\n" * 3000), (4, "u", "twice"), (4, "u", "twice"), (12, "http://h.example/\x00", "\x00\n\x00")]]


def test_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = work_path(spark, "test-warc")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(rows) and all(r.problem is None for r in found)
    bodies = {}
    for i, _, h, *_ in rows:
        bodies.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        keyed = [k for k in bodies[body] if k is not None]
        first = min(keyed) if keyed and len(bodies[body]) > 1 else None
        revisit = first is not None and i != first
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response",
                     str(first) if revisit else None, None if revisit else body))
    got = [(str(r.record_key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key,
            None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_payloads_are_not_revisited(spark):
    path = work_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(page_rows(), PAGES), path, revisit_from=10)
    found = warc.read_archives(spark, path).collect()
    assert {r.record_type for r in found if r.payload_bytes < 10} == {"response"}
    assert "revisit" in {r.record_type for r in found}


def test_empty_table(spark):
    path = work_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def one_record(payload=b"hello", **fields):
    data = warc.record("1", "http://x.example/", payload, fields.get("digest", warc.digest(payload)), None, False)
    return data


def test_long_payloads_go_on_in_segments(monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 1000)
    payload = random.Random(1).randbytes(4500)
    data = one_record(payload) + one_record(b"next")
    rows = list(warc.read_records(data))
    assert [r["payload"] for r in rows] == [payload, b"next"]
    assert len(list(warc.single_records(data))) == 6


def test_members_are_plain_gzip():
    data = one_record() + one_record(b"two")
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2
    reader = zlib.decompressobj(wbits=31)
    assert reader.decompress(data).count(b"WARC/1.1") == 1 and reader.eof and data[-1] == 0


@pytest.mark.parametrize("spoil", [
    lambda d: d[:-3], lambda d: d + b"junk", lambda d: d[:len(d) // 2], lambda d: b"no archive",
    lambda d: gzip.compress(gzip.decompress(d).replace(b"hello", b"hallo")),
    lambda d: gzip.compress(gzip.decompress(d).replace(b"hello", b"hell")),
    lambda d: gzip.compress(gzip.decompress(d).replace(b"hello", b"hello!")),
    lambda d: gzip.compress(gzip.decompress(d).replace(b"WARC/1.1", b"WORK/1.1")),
    lambda d: gzip.compress(gzip.decompress(d) * 2), lambda d: one_record(digest="A" * 32)])
def test_broken_archives_are_told(spoil):
    good = one_record()
    rows = list(warc.read_records(good + spoil(good)))
    assert all(r["payload"] == b"hello" for r in rows[:-1]) and rows[-1]["problem"] and len(rows) >= 2


# --- vector searches --------------------------------------------------------


def vector_rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-30, 30, 8).astype(float).tolist(), "x", 0) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, "x", 0) for i in range(200)]  # one vector that a third of all rows share
    rows += [(10_000, None, "x", 0), (10_020, [1.0, None] * 4, "x", 0), (10_040, [float("nan")] * 8, "x", 0),
             (10_060, [float("inf")] * 8, "x", 0), (10_080, [], "x", 0), (None, hot, "x", 0), (10_100, [1.0, 2.0], "x", 0),
             (10_120, [0.0] * 8, "x", 0), (20, rows[20][1], "x", 0)]
    return rows


VECTORS = "vec_id long, embedding array<double>, rank string, score int"


def usable(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = v + [0.0] * (8 - len(v))
    return out


def brute(rows, k, zero=True):
    have = usable(rows, zero)
    ids = sorted(have)
    m = np.array([have[i] for i in ids])
    out = {}
    for q in ids:
        if q % 20 == 0:
            s = m @ np.array(have[q])
            out[q] = sorted(((-x, i) for x, i in zip(s.tolist(), ids) if i != q))[:k]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-float(r.score), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [64, 8192])
def test_exact_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK_ROWS", block)
    rows = vector_rows()
    got = exact_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert by_query(got) == brute(rows, 20)


def test_exact_search_of_few_and_no_rows(spark):
    rows = vector_rows(5)[:5]
    assert by_query(exact_search.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0)) == brute(rows, 20)
    assert exact_search.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("search", [exact_search.top_k, hnsw.nearest])
def test_vectors_are_not_sent_through_the_driver(spark, monkeypatch, search):
    plans = []

    def planned(df, name):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return cut(df, name)

    for module in (vectors, exact_search, hnsw):
        monkeypatch.setattr(module, "cut", planned)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    rows = cut(spark.createDataFrame(vector_rows(), VECTORS), "test-rows")
    planned(search(rows, F.col("vec_id") % 20 == 0), "test-found")
    sent = [x for p in plans for x in re.findall(r"BroadcastExchange\nInput \[\d+\]: (.*)", p)]
    assert len(plans) == 4
    assert not [x for x in sent if re.search(r"\b(vec|vecs|query_vec|query_vecs|cells)#", x)]


def test_query_blocks_meet_every_block(spark):
    asked = spark.createDataFrame([(i, [float(i), 1.0], i) for i in range(5)] + [(3, [3.0, 1.0], 9)], "rep long, vec array<double>, vec_id long")
    data = spark.createDataFrame([(b, f"block {b}") for b in (0, 1, 2)], "block int, name string")
    met = vectors.meet(cut(data, "test-data"), cut(asked, "test-asked"), 3)
    assert "Broadcast" not in spark._jvm.PythonSQLUtils.explainString(met._jdf.queryExecution(), "formatted")
    got = {(r.block, r["name"]): vectors.unpack(r.query_ids, r.query_vecs) for r in met.collect()}
    assert got.keys() == {(b, f"block {b}") for b in (0, 1, 2)}
    assert all(ids.tolist() == list(range(5)) and vecs.tolist() == [[i, 1] for i in range(5)] for ids, vecs in got.values())


def test_large_integers_stay_exact():
    big = np.array([2.0 ** 40 + 1, 3.0])
    assert exact_search.exact_scores(big, np.array([[2.0 ** 20, 1.0]])).tolist() == [(2 ** 40 + 1) * 2 ** 20 + 3]
    assert exact_search.exact_scores(np.array([1e300]), np.array([[1e300], [-1e300]])).tolist() == [2 ** 63 - 1, -2 ** 63]


def test_hnsw_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    points = centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 32))
    rows = [(i, p.tolist(), "x", 0) for i, p in enumerate(points * rng.uniform(0.5, 2, (3000, 1)))]
    got = by_query(hnsw.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0))
    m = np.array([r[1] for r in rows])
    hits = 0
    for q, found in got.items():
        scores = m @ m[q]
        scores[q] = -np.inf
        hits += len({i for _, i in found} & set(np.argsort(-scores)[:20].tolist()))
        assert len(found) == 20 and found == sorted(found) and q not in {i for _, i in found}
        assert all(-s == pytest.approx(m[q] @ m[i], rel=1e-12) for s, i in found)
    assert len(got) == 150 and hits / (20 * len(got)) >= 0.97


def test_hnsw_with_odd_vectors(spark):
    rows = vector_rows(60)
    got, want = by_query(hnsw.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0)), brute(rows, 20, zero=False)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.95
    few = vector_rows(5)[:3]
    assert by_query(hnsw.nearest(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 20 == 0)) == brute(few, 20)
    assert hnsw.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_graphs_survive_storing():
    points = np.random.default_rng(3).normal(size=(900, 16))
    graph = hnsw.Graph.build(points)
    flat = np.concatenate([layer.reshape(-1) for layer in graph.layers]).astype("<i4")
    again = hnsw.stored_graph(points, graph.counts, flat.tobytes())
    assert len(graph.counts) > 1 and (graph.nearest(points[:50]) == again.nearest(points[:50])).all()
    assert all((layer < n).all() for layer, n in zip(graph.layers, graph.counts))


# --- URL filters ------------------------------------------------------------

URLS = "page_id long, url string, html string, host string, verdict int"


def test_rules(spark):
    urls = ["http://Foo.NET/x", "https://example.net/en/1?q", "https://www.example.net/en", "http://a.example.net/en/#x", "http://a.example.com/de/1",
            "http://b.org/fr/1", "http://net", "http://xnet/", "ftp://u@h:8/p", None, "", "no scheme", "http:///path", "x://É.NET/ü", "http://a.net?x/"]
    rows = spark.createDataFrame([(i, u, None, "clash", 1) for i, u in enumerate(urls)] + [(0, urls[0], None, "clash", 1), (None, urls[1], "", "c", 1)], URLS)
    got = url_filter.judge_urls(rows).collect()
    assert len(got) == len(urls) + 2
    by_id = {r.page_id: (r.host, r.path, r.rule) for r in got if r.page_id is not None}
    assert by_id == {
        0: ("foo.net", "/x", "net/"), 1: ("example.net", "/en/1", "example.net/en/"), 2: ("www.example.net", "/en", "net/"),
        3: ("a.example.net", "/en/", "example.net/en/"), 4: ("a.example.com", "/de/1", "example.com/de/"), 5: ("b.org", "/fr/1", "org/fr/"),
        6: ("net", "", None), 7: ("xnet", "/", None), 8: ("u@h:8", "/p", None), 9: ("", "", None), 10: ("", "", None), 11: ("", "", None),
        12: ("", "/path", None), 13: ("É.net".lower().replace("é", "É"), "/ü", "net/"), 14: ("a.net", "", None)}
    verdicts = {r.page_id: r.verdict for r in got}
    assert [verdicts[i] for i in range(6)] == ["block", "allow", "block", "allow", "block", "allow"] and verdicts[9] == verdicts[7] == "allow"
    assert verdicts[14] == "allow"  # no rule fits an empty path, and nothing else is known of the host
    assert url_filter.judge_urls(spark.createDataFrame([], URLS)).count() == 0


def brute_propagation(links, seed, rounds=60, damping=0.85):
    hosts = sorted({h for l in links for h in l[:2]} | {h for _, h in seed})
    out = {}
    for kind in ("trust", "distrust"):
        edges = [(a, b, n) if kind == "trust" else (b, a, n) for a, b, n in links]
        total = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
        score = {h: (1 - damping) * seed.get((kind, h), 0) for h in hosts}
        base = dict(score)
        for _ in range(rounds):
            new = dict(base)
            for a, b, n in edges:
                new[b] += damping * score[a] * n / total[a]
            score = new
        out |= {(kind, h): s for h, s in score.items() if s > 0}
    return out


def test_propagation_against_brute_force(spark):
    rng = random.Random(4)
    links = sorted({(f"h{rng.randint(0, 15)}", f"h{rng.randint(0, 15)}"): rng.randint(1, 9) for _ in range(60)}.items())
    links = [(a, b, n) for (a, b), n in links if a != b]
    seed = {("trust", "h1"): 1.0, ("trust", "h2"): 0.5, ("distrust", "h3"): 1.0}
    got = url_filter.propagate(spark.createDataFrame(links, "src string, dst string, n long"),
                               spark.createDataFrame([(k, h, s) for (k, h), s in seed.items()], "kind string, host string, seed double"), rounds=60)
    found = {(r.kind, r.host): r.score for r in got.collect() if r.score > 1e-12}
    want = brute_propagation(links, seed)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_linking_to_blocked_hosts_blocks_and_links_from_trusted_ones_save(spark):
    bad = '<a href="http://spam.net/1">x</a> <A HREF=//SPAM.net/2>y</a>'
    rows = [(1, "http://spam.net/", ""), (2, "http://farm.example/", bad), (3, "http://farm.example/2", bad), (4, "http://plain.example/", '<a href="/in">x</a>'),
            (5, "http://good.org/fr/1", '<a href="http://mixed.example/">m</a>'), (6, "http://mixed.example/", bad + '<a href=http://good.org/>g</a>'),
            (7, None, bad), (8, "http://farm.example/", None)]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}


def test_links_are_counted_per_page(spark):
    html = '<a href="http://b.example/1"><a href="http://B.example/2"><a href=\'https://c.example:80?x\'><link href="//d.example"><a href="http://a.example/self">'
    pages = spark.createDataFrame([("a.example", html), ("a.example", html), ("", html)], "host string, html string")
    assert sorted(tuple(r) for r in url_filter.host_links(pages).collect()) == [
        ("a.example", "b.example", 2), ("a.example", "c.example:80", 2), ("a.example", "d.example", 2)]
