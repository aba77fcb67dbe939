"""Frequent lines and verdicts against brute force over distinct texts."""

import re
from collections import Counter, defaultdict

import duckdb

from lakemill.llm.quality import quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def verdicts(docs):
    """id: (words in frequent lines, kept)."""
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in docs:
        texts[host].add(text)
        for line in text.split("\n"):
            if WORD.search(line):
                holders[host, normal(line)].add(text)
    often = {k for k, v in holders.items() if len(v) > 25 and len(v) > 0.05 * len(texts[k[0]])}
    out = {}
    for doc, text, host in docs:
        n = len(WORD.findall(text))
        lost = sum(len(WORD.findall(x)) for x in text.split("\n") if WORD.search(x) and (host, normal(x)) in often)
        out[doc] = lost, not base(text) and n - lost >= 0.3 * n
    return out


def test_verdicts(spark):
    """The tables' texts, some with a long notice; and documents that share their only common words."""
    docs = [(i, t or "", s) for i, t, s in duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet' order by doc_id").fetchall()]
    notice = " ".join(f"notice{k}x" for k in range(400))
    docs = [(i, f"{t}\n{notice}" if "to" in t.split() and i % 3 else t, s) for i, t, s in docs]
    long = "all rights are kept by " + " ".join(f"owner{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    docs += [(10**6 + i, f"{long}\n" + " ".join(f"d{i}w{k}" for k in range(20)), "plain") for i in range(60)]
    docs += [(2 * 10**6 + i, f"{long}\none text, copied", "copies") for i in range(60)]
    want = verdicts(docs)
    assert {want[10**6 + i][1] for i in range(60)} == {False} and {want[2 * 10**6 + i][1] for i in range(60)} == {True}
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {x["doc_id"]: (x["n_removed_words"], x["kept"]) for x in quality_rules(table).collect()} == want


def test_without_frequent_lines(spark):
    from lakemill.llm.quality import without_frequent_lines, line_signals, frequent_lines

    docs = [(i, f"Own line {chr(97 + i % 26)}{chr(97 + i // 26)}\nPage {i} of the notice", "a") for i in range(40)] + [(99, "Page 1 of the notice", "b"), (100, None, "a")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    often = frequent_lines(line_signals(table, "doc_id", "text", "source"))
    got = {x["doc_id"]: x["text"] for x in without_frequent_lines(table, often).collect()}
    assert got == {i: t.split("\n")[0] if t and s == "a" else t for i, t, s in docs}
