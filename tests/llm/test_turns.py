"""Conversation repair against every possible edit of small conversations, and a search over longer ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lakemill.llm import queries as Q
from lakemill.llm import turns

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(row, fault):
    """(letter, cost, turn left) of what may be done with a row."""
    _, _, role, text = row
    yield "D", 4, None
    if fault not in ("blank", "duplicate"):
        more = 3 * (fault == "truncated")
        yield "K", more, (role, text)
        for other in ("user", "assistant"):
            yield "R", 3 + more, (other, text)


def every(rows, found):
    """All edits with up to two insertions at each place; the least (cost, audit) of those that fit, and its turns."""
    put = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for ins in itertools.product(put, repeat=len(rows) + 1):
        for own in itertools.product(*(list(edits(r, f)) for r, f in zip(rows, found, strict=True))):
            left, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                left += [(x, "") for x in ins[k]]
                audit, cost = audit + "I" * len(ins[k]), cost + 3 * len(ins[k])
                if k < len(rows):
                    audit, cost = audit + own[k][0], cost + own[k][1]
                    left += [own[k][2]] if own[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in left)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, left
    return best


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def searched(rows, found):
    """The same by a cheapest-first search over (rows done, last letter)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, left = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, list(left)
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", k, role[0], (*left, (role, ""))))
        if k < len(rows):
            for letter, more, turn in edits(rows[k], found[k]):
                if turn is None:
                    heapq.heappush(heap, (cost + more, audit + letter, k + 1, state, left))
                elif (to := NEXT.get((state, turn[0][:1]))) is not None:
                    heapq.heappush(heap, (cost + more, audit + letter, k + 1, to, (*left, turn)))


def wanted(rows, conv, best):
    found, told = faults(rows), defaultdict(int)
    for f in found:
        told[f] += 1
    numbers = [t for _, t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, left = best(rows, found)
    lines = "\n".join(f"{r}:{t}" for r, t in left)
    return conv, gaps, told["blank"], told["duplicate"], told["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def expected(rows, best=searched):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    return sorted((wanted(sorted(by[c], key=order), c, best) for c in {r[0] for r in rows}), key=str)


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def made(n, turns_each, seed):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["One.", "Two!", "three", "", " \n", "Four?\t", "five. six", None, "One."]
    for conv in range(n):
        for t in range(rng.randint(1, turns_each)):
            rows.append((conv if conv else None, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_small_conversations_against_all_edits(spark):
    rows = made(60, 3, 1)
    assert got(turns.repair_digests(spark.createDataFrame(rows, SCHEMA))) == expected(rows, every)


@pytest.mark.parametrize("block", [1, 9])
def test_longer_conversations_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "LEVELS", (block + 2, 33, 63))
    rows = made(25, 40, 2) + [(99, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(150)] + [(98, None, "user", "Same.")] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(turns.repair_digests(df)) == expected(rows)


def test_whole_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert got(Q.QUERIES["op11_repair"](spark, SF)) == expected(rows)


def test_odd_tables(spark):
    none = turns.repair_digests(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    rows = [(None, None, None, None), (2**63 - 1, -(2**63), "user", "Hi."), (2**63 - 1, 2**63 - 1, "assistant", "Yes."), (5, 1, "user", "word " * 200_000 + "."), (5, 2, "assistant", "Ok.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cost string, block int")
    told = {r[0]: r for r in got(turns.repair_digests(df))}
    assert told[2**63 - 1][1] == 0  # gaps beyond 64 bits are told as none
    want = {r[0]: r for r in expected(rows)}
    assert all(told[c] == want[c] for c in (None, 5))


def test_repaired_turns_are_given(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again.")]
    x = turns.repaired(spark.createDataFrame(rows, SCHEMA)).first()
    assert (x.cost, x.audit, [tuple(t) for t in x.turns]) == (3, "RK", [("user", "Hello."), ("assistant", "Again.")])
