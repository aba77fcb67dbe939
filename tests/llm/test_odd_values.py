"""Values of the operators on odd rows: nulls, empty, long and repeated texts, ties, clashing columns, empty tables."""

import zlib

import numpy as np
import pytest

from lakemill.llm import queries as Q

LONG = "lorem ipsum dolor sit amet, " * 4000
ROWS = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (None, LONG, "x"), (3, LONG, "x"), (4, "", "y"), (5, " \n\t", "y"), (-6, "Straße ÉTÉ 12.5", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("size", "rank", "node", "n_words", "kept", "target", "text_hash", "bands", "id", "mixed", "start", "length", "key", "tag", "found", "n_bytes", "label", "bits")
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", *(f"0 as {c}" for c in clash))


def ids_of(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(Q.tokenizer()).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, odd):
    from lakemill.llm.tokens import token_files

    got = sorted(token_files(odd, Q.tokenizer(), 2).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [None, -6, 1, 1, 2, 3, 4, 5]
    texts, at = {(d): t for d, t, _ in ROWS}, 0
    for x in got:
        ids = ids_of(texts[x["doc_id"]], 2)
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files(odd.limit(0), Q.tokenizer(), 2).count() == 0


def test_packing(spark, odd):
    from lakemill.llm.packing import packed

    got = packed(odd, Q.tokenizer()).collect()
    texts = {d: t for d, t, _ in ROWS}
    want = sorted((str(d), p, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for d, t, _ in ROWS for ids in [ids_of(t, 1)] for p, s in enumerate(range(0, len(ids), 4096)))
    assert sorted((str(x["doc_id"]), x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    ends = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == ends.get(x["sequence_id"], 0)
        ends[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(ends.values()) <= 4096 and len(texts) == 7
    assert packed(odd.limit(0), Q.tokenizer()).count() == 0


def repeats_by_force(texts, length=200):
    from collections import Counter

    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~cover])))
    return out


def test_repeats(spark, odd):
    import hashlib

    from lakemill.llm.suffixes import without_repeats

    texts = [(t or "").encode() for _, t, _ in ROWS]
    want = sorted((str(d), n, r, s, hashlib.sha256(left).hexdigest(), 0) for (d, _, _), (n, r, s, left) in zip(ROWS, repeats_by_force(texts), strict=True))
    got = without_repeats(odd, keep=("text_hash", "n_bytes", "found")).collect()
    assert sorted((str(x[0]), x[4], x["n_removed"], x["n_spans"], x["kept_sha256"], x["text_hash"]) for x in got) == want
    assert without_repeats(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1024, 3])
def test_repeated_anchors(spark, hot):
    """One passage in many surroundings and often in one text: an anchor that is dealt out by ranges of offsets."""
    import hashlib
    import random

    from lakemill.llm.suffixes import without_repeats

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = " ".join(word() for _ in range(45))
    texts = [" ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(30))), *([passage[: rng.randrange(150, 380)], word(), passage] if k % 7 == 0 else [])]) for k in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in without_repeats(table, hot=hot).collect()}
    for k, (n, removed, spans, left) in enumerate(repeats_by_force([t.encode() for t in texts])):
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (n, removed, spans, hashlib.sha256(left).hexdigest())


def test_shared_hash(spark, monkeypatch):
    """Two texts of one 64-bit hash are still two texts."""
    from pyspark.sql import functions as F

    from lakemill.llm import suffixes

    real = F.xxhash64
    monkeypatch.setattr(suffixes.F, "xxhash64", lambda *c: real(*c) % 2 if c == ("text",) else real(*c))
    table = spark.createDataFrame([(k, f"{k} " * 150) for k in range(6)] + [(9, "0 " * 150)], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.without_repeats(table).collect()}
    monkeypatch.undo()
    assert got == {0: 300, 9: 300, **{k: 300 for k in range(1, 6)}}  # each repeats within itself, too
