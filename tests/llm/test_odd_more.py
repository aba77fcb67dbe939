"""Values of top-k search, URL filter, license scan and HTML text on odd rows, and the SQL of corpus queries."""

import duckdb
import pytest

from lakemill.llm import queries as Q

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = [
    (0, [1.0, 2.0]), (100, [-1.0, 0.5]), (200, None), (300, [1.0, None]), (400, [NAN, 1.0]), (500, [INF, 1.0]), (None, [1.0, 1.0]),
    (600, [3.0, 3.0, 3.0]), (7, [0.5, 0.5]), (5, [0.5, 0.5]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (11, [1e12, -1e12]), (700, [1e12, 1e12]),
    (12, [1e300, 0.0]), (13, [0.0001, -0.0001]), (800, [1.0]), (14, []),
]


def whole(x):
    return min(max(int(1024 * x // 1) if abs(x) < 1e15 else int(x) * 1024, -(2**63)), 2**63 - 1)


def test_top_k(spark):
    import math

    from lakemill.llm.vectors import exact_top_k

    table = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").selectExpr("*", "0 as score", "0 as rank", "0 as query_id", "0 as vector")
    sound = [(i, [whole(math.floor(1024 * x) / 1024 if abs(x) < 1e9 else x) for x in v]) for i, v in VECTORS if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    limit = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for k in (2, 10):
        want = []
        for q, a in sound:
            if q % 100 == 0:
                best = sorted((-limit(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in sound if i != q and len(a) == len(b))[:k]
                want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
        got = exact_top_k(table, table.filter("vec_id % 100 = 0"), k).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_top_k(table.limit(0), table).count() == exact_top_k(table, table.limit(0)).count() == 0


URLS = [
    (1, None, "", "", None), (1, None, "", "", None), (2, "", "", "", None), (3, "no scheme", "", "", None), (None, "http://A.Example.NET", "a.example.net", "", None),
    (4, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"), (5, "https://net/p", "net", "/p", "net/"), (6, "x://notnet/p", "notnet", "/p", None),
    (7, "http://example.com/de/?a=://b", "example.com", "/de/", "example.com/de/"), (8, "http://w.org?u=http://b.net/", "w.org", "", None),
    (9, "http://w.org/fr/" + "a" * 100_000, "w.org", "/fr/" + "a" * 100_000, "org/fr/"), (10, "http://x.net/en/\nline", "x.net", "/en/\nline", "net/"),
]


def test_urls(spark):
    from lakemill.llm.urls import url_filter

    clash = ("host", "path", "rule", "label", "score", "length", "depth", "features", "suffix", "of", "mean")
    table = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string").selectExpr("*", *(f"0 as {c}" for c in clash))
    got = url_filter(table, Q.URL_RULES).collect()
    assert sorted((str(x["page_id"]), x["host"], x["path"], str(x["rule"])) for x in got) == sorted((str(i), h, p, str(r)) for i, _, h, p, r in URLS)
    verdicts = dict(Q.URL_RULES)
    assert all(x["verdict"] == verdicts[x["rule"]] if x["rule"] else x["verdict"] in ("allow", "block") for x in got)
    assert len({x["verdict"] for x in got if x["page_id"] == 1}) == 1
    assert url_filter(table.limit(0), Q.URL_RULES).count() == 0
    assert {x["verdict"] for x in url_filter(table, ()).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    """Trees fitted on labelled URLs tell others of the same two kinds apart."""
    from lakemill.llm.urls import url_filter

    good = [f"https://www.site{i % 40}.org/news/article-{'abcdefghij'[i % 10]}" for i in range(400)]
    bad = [f"http://x{i * 7919 % 100_000}.top/{i * 104_729 % 10**9}/?id={i}&s={i * 31}&k=9" for i in range(400)]
    known = spark.createDataFrame([(u, int(u in bad)) for u in good[:200] + bad[:200]], "url string, label int")
    asked = spark.createDataFrame(list(enumerate(good[200:] + bad[200:])), "page_id long, url string")
    got = {x["page_id"]: x["verdict"] for x in url_filter(asked, (), labelled=known).collect()}
    assert sum(got[i] == ("block" if i >= 200 else "allow") for i in range(400)) >= 380


def test_licenses(spark):
    from lakemill.llm.licenses import license_scan

    long = "word " * 30_000 + "Licensed under the MIT License. " + "word " * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "Released under the MIT License."), (5, "RELEASED under the\nMIT license"), (5, "RELEASED under the\nMIT license"), (6, long)]
    clash = ("template", "license", "bands", "held", "own", "wanted", "phrases", "n_found", "x")
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"0 as {c}" for c in clash))
    got = license_scan(table).collect()
    assert {x["license"] for x in got} == {"MIT"}
    assert {x["doc_id"] for x in got} == {None, 5, 6} and [x["doc_id"] for x in got if x["template"] == 0 and x["containment"] == 1.0].count(5) == 2
    assert license_scan(table.limit(0)).count() == 0 and license_scan(table, ()).count() == 0


def test_html(spark):
    from lakemill.llm.html import extract_text

    page = "<article><p>One, two.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "v", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 as text", "0 as n_chars", "0 as node")
    got = extract_text(table).collect()
    want = [(i, u, "One, two." if h else "", 9 if h else 0) for i, u, h in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert extract_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_against_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = Q.QUERIES[name](spark, sf_dir)
    want = con.execute(f"select {', '.join(found.columns)} from ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
