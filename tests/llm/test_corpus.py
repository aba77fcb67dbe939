"""The corpus operators against brute force on the smallest tables, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lakemill.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows(spark, name):
    return [x.asDict() for x in Q.QUERIES[name](spark, SF).collect()]


def token_ids(text, end):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(Q.tokenizer())
    return np.array([*encoder.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs):
    got, start = sorted(rows(spark, "op1_token_files"), key=lambda x: x["doc_id"]), 0
    assert len(got) == len(docs)
    for x, (doc, text, _) in zip(got, docs, strict=True):
        ids = token_ids(text, 2)
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_quality_counts(spark, docs):
    got = {x["doc_id"]: x for x in rows(spark, "op3_quality_rules")}
    assert len(got) == len(docs)
    for doc, text, _ in docs:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
        x = got[doc]
        assert (x["n_words"], x["word_chars"], x["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert x["n_dup_lines"] == len(lines) - len(set(lines))
        assert x["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert x["base_failed"] == failed and not (failed and x["kept"])


def test_mixing(spark, docs):
    got = rows(spark, "op4_mixing")
    sizes = {doc: len(WORD.findall(text or "")) for doc, text, _ in docs}
    sources = {doc: source for doc, _, source in docs}
    sums = Counter()
    for doc, n in sizes.items():
        sums[sources[doc]] += n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sums.values())
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > 2 * sums[s]}
        if not full:
            target.update({s: left * weights[s] / total for s in open_})
            break
        target.update({s: 2.0 * sums[s] for s in full})
        left -= sum(2.0 * sums[s] for s in full)
        open_ -= full
    taken, biggest = Counter(), Counter()
    for x in got:
        s = sources[x["doc_id"]]
        assert x["size"] == sizes[x["doc_id"]] and x["source_size"] == sums[s]
        assert math.isclose(x["target"], target[s], rel_tol=1e-9) and x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
        biggest[s] = max(biggest[s], x["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, "op4_mixing")))


def test_repeats(spark, docs):
    got = {x["doc_id"]: x for x in rows(spark, "op5_repeats")}
    texts = {doc: (text or "").encode() for doc, text, _ in docs}
    starts = Counter(hash(t[i : i + 200]) for t in texts.values() for i in range(len(t) - 199))
    for doc, t in texts.items():
        cover, runs, at = np.zeros(len(t), bool), 0, -1
        for i in range(len(t) - 199):
            if starts[hash(t[i : i + 200])] > 1:
                cover[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(t, np.uint8)[~cover])
        x = got[doc]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (len(t), int(cover.sum()), runs, hashlib.sha256(left).hexdigest()), doc


def test_packing(spark, docs):
    got = rows(spark, "op6_packing")
    ids = {doc: token_ids(text, 1) for doc, text, _ in docs}
    bins, by_doc = defaultdict(list), defaultdict(list)
    for x in got:
        own = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(own.tobytes()) == x["ids_crc32"] and len(own) == x["length"]
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
        by_doc[x["doc_id"]].append((x["piece"], x["start"], x["length"]))
    for doc, own in ids.items():
        assert sorted(by_doc[doc]) == [(k, s, min(4096, len(own) - s)) for k, s in enumerate(range(0, len(own), 4096))]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.01 * sum(map(len, ids.values())) / 4096 + 2


def test_top_k(spark):
    vectors = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    scaled = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors}
    want = set()
    for q in (i for i in scaled if i % 100 == 0):
        best = sorted((-int(scaled[q] @ v), i) for i, v in scaled.items() if i != q)[:10]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in rows(spark, "op7_top_k")} == want


def shingle_set(text, n, word=WORD):
    words = word.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_near_duplicates(spark, docs):
    sets = {doc: shingle_set(text, 2) for doc, text, _ in docs}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in rows(spark, "op10_near_duplicates")}
    assert got == {doc: (len(sets[doc]), find(doc), find(doc) == doc) for doc in ids}


def test_licenses(spark, docs):
    from lakemill.llm.licenses import TEMPLATES

    def pairs(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}

    wanted = [pairs(t) for _, t in TEMPLATES]
    loose = {(doc, t) for doc, text, _ in docs for t, w in enumerate(wanted) if 100 * len(pairs(text or "") & w) >= 80 * len(w)}
    passages = {(doc, t) for doc, text, _ in docs for t, (_, notice) in enumerate(TEMPLATES) if notice in (text or "")}
    got = {(x["doc_id"], x["template"]) for x in rows(spark, "op9_licenses")}
    assert passages and passages <= got <= loose


def test_html_text(spark):
    """All pages of the table have one article of headings and paragraphs: its blocks, found by splitting at their tags."""
    import html

    pages = {x[0]: x[1:] for x in duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()}
    got = rows(spark, "op2_html_text")
    assert len(got) == len(pages)
    for x in got:
        url, source = pages[x["page_id"]]
        inside = source.split("<article>", 1)[1].split("</article>", 1)[0]
        texts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", y))) for y in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inside)]
        want = "\n".join(y for y in (" ".join(y.split()) for y in texts) if y)
        assert (x["url"], x["text"], x["n_chars"]) == (url, want, len(want)), x["page_id"]


PAGES = [
    (None, ""),
    ("", ""),
    ("<html><head><title>t</title></head><body></body></html>", ""),
    ("no markup, a &lt;b&gt; &amp; 1 &#60; 2\n\n  end", "no markup, a <b> & 1 < 2 end"),
    ("<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One,  two\n three.<p>Four <i>fi</i>ve.</article><footer>end</footer>", "T & U\nOne, two three.\nFour five."),
    ("<div class='sidebar'><p>Side, side, side, side.</div><div id=content><p>Body, text, here.</p><script>x('<p>no')</script><p>More.</p></div><div class='comments'><p>I, too, think, so.</p></div>", "Body, text, here.\nMore."),
    ("<main><p>Kept, whole.</p><form><p>Name, please: <input></p></form><aside>Advert</aside><p>End.</p></main>", "Kept, whole.\nEnd."),
    ("<article><ul><li>a, b</li><li>c</ul><table><tr><td>d<td>e</table></article>", "a, b\nc\nd\ne"),
    ("<article><p>" + "word, " * 60_000 + "</p></article>", ("word, " * 60_000).strip()),
    ("<div>" * 3000 + "<p>Deep, text.</p>" + "</div>" * 3000, "Deep, text."),
]


@pytest.mark.parametrize("source, want", PAGES, ids=range(len(PAGES)))
def test_html_cases(source, want):
    from lakemill.llm.html import main_text

    assert main_text(source) == want


def test_urls(spark):
    pages = rows(spark, "op2_html_text")
    judged = rows(spark, "op8_url_filter")
    assert len(judged) == len(pages)
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for x in judged:
        fits = [r for r in rules if ("." + x["host"]).endswith("." + r.split("/", 1)[0]) and x["path"].startswith("/" + r.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        assert x["rule"] == best and x["verdict"] == (rules[best] if best else x["verdict"]) and x["verdict"] in ("allow", "block")


def test_odd_rows(spark):
    """Null ids, texts and sources, empty and repeated rows, clashing columns and empty tables."""
    from lakemill.llm.licenses import license_scan
    from lakemill.llm.mixing import mix
    from lakemill.llm.neardup import near_duplicates
    from lakemill.llm.packing import packed
    from lakemill.llm.quality import quality_rules
    from lakemill.llm.suffixes import without_repeats
    from lakemill.llm.tokens import token_files

    long = "lorem ipsum dolor sit amet " * 100
    data = [(1, "a", None), (1, "a", None), (2, None, "x"), (None, long, "x"), (3, long, "x"), (4, "", "y"), (5, " \n\t", "y")]
    plain = spark.createDataFrame(data, "doc_id long, text string, source string")
    odd = plain.selectExpr("*", "0 as size", "0 as rank", "0 as node", "0 as n_words", "0 as kept", "0 as target", "0 as text_hash", "0 as bands")
    for table, n in ((odd, 7), (odd.limit(0), 0)):
        assert quality_rules(table).count() == mix(table).count() == near_duplicates(table).count() == without_repeats(table).count() == n
        assert token_files(table, Q.tokenizer(), 2).count() == n and packed(table, Q.tokenizer()).count() == n
        assert license_scan(table).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P
    from lakemill.llm.common import staged

    documents = Q.table(spark, SF, "documents")
    docs = documents
    for name, stage in P.STAGES[:-1]:
        after = staged(stage(spark, docs, SF), "t")
        assert after.columns == documents.columns and 0 < after.count(), name
        if name == "quality_rules":
            kept = {x["doc_id"] for x in rows(spark, "op3_quality_rules") if x["kept"]}
            assert {x[0] for x in after.select("doc_id").collect()} == kept
        if name == "near_duplicates":
            sets = {x[0]: shingle_set(x[1], 5) for x in after.select("doc_id", "text").collect()}
            ids = sorted(sets)
            assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :])
        docs = after
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count()
