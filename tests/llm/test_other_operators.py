"""Top-k, url filter, sharding and WARC on small fixtures."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding, topk, urls, warc
from tessera.llm.common import components, gapless_rank


# ---- top-k ----------------------------------------------------------------
def vector_rows(seed=0):
    rng = np.random.RandomState(seed)
    rows = [(i, (rng.randn(12) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]               # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")] * 12), (404, []),
             (405, [2.0]), (None, [1.0] * 12), (40, rows[40][1]), (406, [0.0] * 12)]
    return rows


def brute_top(rows, k, scale, asks):
    v = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v.append((i, [int(np.floor(scale * c)) for c in x] + [0] * (12 - len(x))))
    out = []
    for n, (q, w) in enumerate(v):
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(w, x)), i) for m, (i, x) in enumerate(v) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_bounds_save_most_products():
    """Blocks by falling length on the given vectors: under half of all products are computed."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, v = np.array(t["vec_id"]), np.floor(64 * np.array(t["embedding"], np.float64))
    norm = np.sqrt((v ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    rotation = np.linalg.svd(v, full_matrices=True)[2].T
    asks = ids % 20 == 0
    group = topk.Group(ids[asks].tobytes(), ids[asks].tobytes(), v[asks].tobytes(), 20)
    for k in range(0, len(order), topk.BLOCK):
        at = order[k:k + topk.BLOCK]
        group.meet(float(norm[at].max()), ids[at], ids[at], v[at], rotation)
    assert group.products < 0.5 * asks.sum() * len(ids)
    best = (v[asks] @ v.T).astype(int)
    best[ids[asks][:, None] == ids] = -10 ** 9
    assert np.array_equal(-np.sort(-best, axis=1)[:, :20].ravel(), group.score)


def test_long_vectors_end_the_search_of_short_ones():
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, 1, (400, 8)) * np.array([1000] * 20 + [1] * 380)[:, None])
    ids = np.arange(400)
    group = topk.Group(ids[:50].tobytes(), ids[:50].tobytes(), v[:50].tobytes(), 3)
    for k in range(0, 400, 20):
        before = group.products
        group.meet(float(np.sqrt((v[k:k + 20] ** 2).sum(1)).max()), ids[k:k + 20], ids[k:k + 20], v[k:k + 20], np.eye(8))
    assert group.products == before


@pytest.mark.parametrize("scale,block", [(64.0, 4096), (64.0, 7), (3e7, 50)])
def test_top_products_equal_all_products(spark, monkeypatch, scale, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "BLOCKS", 3)
    monkeypatch.setattr(topk, "QUERIES", 11)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_products(df, F.col("vec_id") % 4 == 0, 20, scale).collect()
    expect = [(q, r, i, min(max(s, -2 ** 63), 2 ** 63 - 1)) for q, r, i, s in brute_top(rows, 20, scale, lambda i: i % 4 == 0)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == expect


def test_top_products_of_few_and_of_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = topk.top_products(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2), (2, 1)]
    assert topk.top_products(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_products(df, F.lit(False)).count() == 0


# ---- url filter -----------------------------------------------------------
RULES = [("allow", "good.org/"), ("block", "good.org/bad/"), ("block", "evil.com/")]


def test_rules_hosts_and_paths(spark):
    page = [(1, "http://Good.ORG/x?y#z", None), (2, "https://a.good.org/bad/1", ""), (3, "http://notgood.org/", ""), (4, None, ""),
            (5, "no scheme", ""), (6, "http://good.org", ""), (7, "ftp://EVIL.com:80/a", ""), (8, "http://evil.com/?/x", ""),
            (8, "http://evil.com/?/x", ""), (None, "http://evil.com/#", "")]
    df = spark.createDataFrame([(*p, "h") for p in page], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.filter_urls(df, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.org", "/x", "good.org/", "allow")
    assert (got[2].rule, got[2].verdict) == ("good.org/bad/", "block")
    assert got[3].rule is None and got[3].verdict == "allow"
    assert (got[4].host, got[4].path, got[4].verdict) == ("", "", "allow") == (got[5].host, got[5].path, got[5].verdict)
    assert (got[6].path, got[6].rule) == ("", None)
    assert (got[7].host, got[7].rule) == ("evil.com:80", None)
    assert (got[8].path, got[8].verdict) == ("/", "block") and got[None].verdict == "block"
    assert urls.filter_urls(df.limit(0), RULES).count() == 0
    assert urls.filter_urls(df, []).where("verdict = 'block'").count() == 0


def brute_spread(seeds, links, rounds=200):
    out = Counter()
    for s, _, w in links:
        out[s] += w
    base = {n: v * (1 - urls.DAMPING) for n, v in seeds.items() if v}
    now = dict(base)
    for _ in range(rounds):
        new = Counter(base)
        for s, d, w in links:
            if s in now:
                new[d] += urls.DAMPING * now[s] * w / out[s]
        now = new
    return now


def test_trust_and_distrust_flow_along_links(spark):
    rng = random.Random(3)
    hosts = ["good.org"] + ["evil.com"] * 4 + [f"h{k}.net" for k in range(12)]
    page, links = [], Counter()
    for i in range(150):
        src = rng.choice(hosts)
        to = [rng.choice(hosts[5:]) if src != "h1.net" else "evil.com" for _ in range(3)]
        forms = ["<a href='http://{}/x'>", '<A HREF="//{}/y">', "<img src=https://{}>", "<a href='/local/{}'>"]
        html = ""
        for t in to:
            f = rng.choice(forms)
            html += f.format(t)
            if "local" not in f and t != src:
                links[src, t] += 1
        page.append((i, f"http://{src}/p", html))
    df = spark.createDataFrame(page, "page_id long, url string, html string")
    edges = [(s, d, w) for (s, d), w in links.items()]
    assert sorted((r.src, r.dst, r.w) for r in urls.host_links(df).collect()) == sorted((s, d, float(w)) for s, d, w in edges)
    n = Counter(p[1].split("/")[2] for p in page)
    trust = brute_spread({"good.org": n["good.org"]}, edges)
    distrust = brute_spread({"evil.com": n["evil.com"]}, [(d, s, w) for s, d, w in edges])
    got = urls.filter_urls(df, RULES).collect()
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > r.trust * (1 + urls.MARGIN) else "allow")
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def chain_pages(n=40):
    """Hosts that link one to the next, the last of them to a blocked one, and
    links with blanks around the equals sign and the quote."""
    rows = [(k, f"http://c{k}.net/", f"<a href='http://c{k + 1}.net/'>") for k in range(n - 1)]
    rows += [(n - 1, f"http://c{n - 1}.net/", "<a href='http://evil.com/'>"), (n, "http://evil.com/", None)]
    rows += [(100, "http://blanks.net/", "<a href" + " " * 10 + "=" + "\n" * 30 + "'   http://evil.com/'>"),
             (101, "http://good.org/", "<a href='http://friend.net/'>"), (102, "http://friend.net/x", ""),
             (103, "http://alone.net/", "href" * 1000 + " " * 1000 + "x='//evil.com'"), (104, None, "<a href=//evil.com>")]
    return rows


def test_chains_of_hosts_and_blanks_in_links(spark, tmp_path):
    import duckdb

    from tessera.llm import queries
    df = spark.createDataFrame(chain_pages(), "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, RULES).collect()}
    assert [got[k] for k in range(41)] == ["block"] * 41 and got[100] == "block"
    assert got[101] == got[102] == got[103] == got[104] == "allow"
    # The query's SQL, whose rules block example.org/es/, on the same chain.
    rows = [(i, u and u.replace("evil.com/", "example.org/es/"), h and h.replace("evil.com", "example.org"))
            for i, u, h in chain_pages()]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.sql(queries.oracle_sql()["op4_url_filter"])
    want = {r[want.columns.index("page_id")]: r[want.columns.index("verdict")] for r in want.fetchall()}
    found = {r.page_id: r.verdict for r in queries.queries()["op4_url_filter"](spark, str(tmp_path)).collect()}
    assert found == want and [found[k] for k in range(40)] == ["block"] * 40 and found[100] == "block"


def test_flows_that_do_not_settle_raise(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "node string, seed double")
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    with pytest.raises(RuntimeError):
        urls.spread(seeds, ring, most=16)
    got = {r.node: r.score for r in urls.spread(seeds, ring).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85 ** 2)) < 1e-8 and abs(got["b"] - 0.85 * got["a"]) < 1e-8


def test_url_filter_runs_no_python(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "")], "page_id long, url string, html string")
    plan = urls.filter_urls(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- sharding -------------------------------------------------------------
def test_remnants_leave_before_large_groups(spark):
    """Thirty documents in a shard for twenty, all with over 1,000 linked neighbours there."""
    placed = spark.createDataFrame([(k, int(k >= 30)) for k in range(40)], "node long, shard int")
    own = spark.createDataFrame([(k, 1_500 if k % 3 == 0 else 20_000) for k in range(30)], "_n long, own long")
    got = sharding._evened(placed, own, 40, 2, {0: 20, 1: 20}).collect()
    assert {r.node for r in got if r.shard == 1} == {k for k in range(40) if k >= 30 or k % 3 == 0}


def test_sharding_goes_on_until_no_better(spark):
    """Chains of linked pairs: unbounded rounds keep more of them than one round."""
    nodes = spark.range(600).select(F.col("id").alias("node"))
    links = spark.createDataFrame([(k + e, k) for k in range(599) for e in (0, 1) if k % 100 != 99], "node long, group long")
    whole = sharding.place(nodes, links, 3)
    assert sorted(r["count"] for r in whole.groupBy("shard").count().collect()) == [200] * 3
    few = sharding.place(nodes, links, 3, rounds=1)
    assert sharding._kept(whole, links) > sharding._kept(few, links)


def test_shards_are_even_and_copies_stay_together(spark):
    rng = random.Random(1)
    texts = [f"text {k}" for k in range(300)] + ["pair"] * 2 + [f"c{k % 20}" for k in range(80)] + ["hot"] * 200
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "pair"), (901, None), (902, ""), (903, None)]
    got = sharding.shard_documents(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, law string, slot int")).collect()
    assert len(got) == len(rows)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    at = {}
    for r in got:
        at.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    crc = lambda t: (__import__("zlib").crc32(t.encode()), len(t) + 8)
    small = [s for k, s in at.items() if k != crc("hot")]
    assert sum(len(s) > 1 for s in small) <= 3
    # 200 copies at about 24 a shard need nine shards.
    assert len(at[crc("hot")]) <= 12
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_shards_of_few_and_of_none(spark):
    one = sharding.shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert [(r.shard, r.slot, r.size) for r in one] == [(0, 0, 9)]
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gapless_rank_and_components(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    got = gapless_rank(df, ["k"], [F.col("id")], "r").collect()
    for k in range(3):
        assert sorted(r.r for r in got if r.k == k) == list(range(len([r for r in got if r.k == k])))
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(500, 500 + k) for k in range(1, 30)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    expect = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == expect


# ---- WARC -----------------------------------------------------------------
def test_pages_round_trip(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé\r\n😀") for _ in range(9000))
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (0, "http://c/", "x"), (3, None, None), (4, "", ""), (5, "http://d/ e\r\nf", long),
            (6, "http://d/", long), (7, "http://e/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (7, "http://e/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
            (None, "http://f/", "x"), (8, "http://g/", "only")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    for segment in (64, 1000, 10 ** 7):
        got = warc.archived(df, segment).collect()
        assert len(got) == len(rows) and all(r.ok for r in got)
        for page, _, html in rows:
            want = (html or "").encode()
            first = min(p for p, _, h in rows if (h or "") == (html or "") and p is not None)
            for r in (r for r in got if r.page_id == page):
                assert r.payload_bytes == len(want)
                assert r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
                again = page is not None and page != first
                assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
                assert again or bytes(r.payload) == want
    assert warc.archived(df.limit(0)).count() == 0


def test_least_bytes_of_a_revisit(spark):
    from tessera.session import shared_dir
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    path = shared_dir(spark, "warc-test")
    warc.write_archives(df, path, least=3)
    assert {(r.page_id, r.record_type) for r in warc.read_pages(spark, path).collect()} == \
        {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_broken_segments_are_told(spark):
    block = warc.HTTP + warc.chunked(b"payload" * 50)
    cut = [block[k:k + 100] for k in range(0, len(block), 100)]
    said = warc.digest(b"payload" * 50)

    def records(origin, page, numbers, total):
        return [(f"{origin}/{k}", "response" if k == 1 else "continuation", origin, k, total if k == numbers[-1] else None,
                 page if k == 1 else None, None, None, said if k == 1 else None, None, cut[k - 1]) for k in numbers]
    every = list(range(1, len(cut) + 1))
    rows = records("a", 1, every, len(block)) + records("b", 2, [k for k in every if k != 2], len(block)) \
        + records("c", 3, every, len(block) + 1) + records("d", 4, every[:-1], None) + records("e", 5, every + [every[-1]], len(block))
    random.Random(0).shuffle(rows)
    r = warc.reassembled(spark.createDataFrame(rows, warc.RECORD))
    got = {x.page_id: x for x in r.mapInArrow(lambda it: warc._decoded(True)(b.select(
        ["page_id", "uri", "kind", "refers_to", "payload_digest", "payload_bytes", "whole", "block"]) for b in it), warc.PAGE).collect()}
    assert {k: v.ok for k, v in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert bytes(got[1].payload) == b"payload" * 50


def test_chunk_framing():
    for n in (0, 1, 1999, 2000, 2001, 7000):
        p = bytes(range(256)) * (n // 256 + 1)
        assert warc.unchunked(warc.chunked(p[:n])) == p[:n]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(broken) is None
