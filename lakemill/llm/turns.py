"""Conversation structure repair by a fold over turns (operator 11).

Roles must begin with the letters of ``(s?(ua)+)?``. The automaton of that expression has four states: nothing yet, after
the system turn, after a user, after an assistant. Edits of a row and insertions before it move from state to state;
``aggregate()`` carries the cheapest way into each state as a struct of cost and audit, the letters of the edits so far,
and ``least`` of such structs is both the cheaper way and, among equal costs, the lesser audit. A state and an audit fix
the roles of what is inserted or given another role, so no way is lost by keeping one a state. Within this module a kept
system turn has the letter L, which sorts as K does; it is told as K.

Rows are sorted by ranges and cut into blocks of BLOCK rows, so a long conversation is folded by many tasks: a block that
continues one is folded from each of the four states, and blocks are joined by the same ``least``, in three levels. Only
its results, an audit and a repaired text, are one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.llm.common import dropped, let, staged

BLANKS = " \t\n\v\f\r"
NONE, SYSTEM, USER, ASSISTANT = STATES = ("none", "system", "user", "assistant")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows of a block, blocks joined at once; positions hold the range in their upper and the row in their lower 33 bits.
BLOCK, LEVELS = 9, (15, 33, 63)
WAY = "struct<cost:bigint,audit:string>"
WAYS = "struct<" + ",".join(f"{x}:{WAY}" for x in STATES) + ">"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text with faults put in by crc32 of ``conv_id:turn`` modulo 20; nulls of role, text and that key are one space.

    0 drops the row, 1 empties its text, 2 removes its full stops, 3 repeats it with the same turn, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank(conv_col), blank(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("times"))
    return rows.drop("times")


def _way(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _add(way: Column, cost: Column | int, letter: str) -> Column:
    """``way`` with one edit more; null if there is none."""
    return F.when(way.isNotNull(), _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letter))))


def _ways(*ways: Column) -> Column:
    return F.struct(*(w.alias(x) for w, x in zip(ways, STATES, strict=True)))


def _inserted(v: Column) -> Column:
    """The ways with up to two insertions more; a third would only lead back to a state that was cheaper before."""
    put = lambda way: _add(way, INSERT, "I")
    once = lambda w: _ways(w[NONE], w[SYSTEM], F.least(w[USER], put(w[NONE]), put(w[SYSTEM]), put(w[ASSISTANT])), F.least(w[ASSISTANT], put(w[USER])))
    return let(once(v), once)


def _step(v: Column, t: Column) -> Column:
    """The ways behind row ``t``: kept if its letter fits, given the role that fits, or deleted."""
    cut = F.when(t["fault"] == "truncated", CUT).otherwise(0)
    stays = ~t["fault"].isin("blank", "duplicate")
    keep = lambda way, letter: F.when(stays & (t["letter"] == letter), _add(way, cut + KEEP, "L" if letter == "s" else "K"))
    other = lambda way: F.when(stays, _add(way, cut + REROLE, "R"))
    gone = lambda way: _add(way, DELETE, "D")
    before = (NONE, SYSTEM, ASSISTANT)
    return _ways(
        gone(v[NONE]),
        F.least(gone(v[SYSTEM]), keep(v[NONE], "s")),
        F.least(gone(v[USER]), *(keep(v[x], "u") for x in before), *(other(v[x]) for x in before)),
        F.least(gone(v[ASSISTANT]), keep(v[USER], "a"), other(v[USER])),
    )


def _begin(state: str) -> Column:
    """The ways of nothing edited yet, from ``state``."""
    return _ways(*(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")) if x == state else F.lit(None).cast(WAY) for x in STATES)).cast(WAYS)


def folded(turns: Column, begin: Column) -> Column:
    """The cheapest way into each state over an array of turns (letter, fault), from the ways ``begin``."""
    return F.aggregate(turns, begin, lambda v, t: let(_inserted(v), lambda w: _step(w, t)).cast(WAYS))


def _joined(first: Column, rest: Column) -> Column:
    """``first`` (ways), continued by a block's ``rest``: its ways from each state."""
    on = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), _way(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"])))
    return _ways(*(F.least(*(on(first[x], rest[k][y]) for k, x in enumerate(STATES))) for y in STATES)).cast(WAYS)


def _end(v: Column) -> Column:
    """The cheapest way that ends the expression: nothing at all, or behind an assistant."""
    return let(_inserted(v), lambda w: F.least(w[NONE], w[ASSISTANT]))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their position ``pos`` in the order of conversation, turn, role and text, staged. Equal rows may lie in different ranges."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    last = F.substring(trimmed, -1, 1)
    ranged = ranged.drop("copy").withColumn("pos", F.monotonically_increasing_id())
    return staged(ranged.withColumn("last", last).withColumn("letter", F.substring("role", 1, 1)).withColumn("digest", F.sha2("text", 256)), "turns")


def _repeats(rows: DataFrame) -> DataFrame:
    """conv_id and pos of rows whose role and text their conversation had before: ranked within a range first, then the first of each range."""
    same = ["conv_id", "role", "digest"]
    here = rows.select(*same, "pos", F.shiftright("pos", 33).alias("range"))
    here = here.withColumn("n", F.row_number().over(W.partitionBy(*same, "range").orderBy("pos")))
    firsts = here.filter("n = 1").withColumn("n", F.row_number().over(W.partitionBy(*same).orderBy("pos")))
    return here.filter("n > 1").select("conv_id", "pos").union(firsts.filter("n > 1").select("conv_id", "pos"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of each conversation: its turns with their faults, counts, and what its ends need to be joined."""
    block = F.shiftright("pos", BLOCK).alias("block")
    again = _repeats(rows).groupBy("conv_id", block).agg(F.collect_list("pos").alias("again")).withColumnsRenamed({"conv_id": "c", "block": "b"})
    w = W.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.select("conv_id", block, "pos", "turn", "letter", "role", "text", "last")
    rows = rows.withColumn("before", F.lag("letter").over(w)).withColumn("turn_before", F.lag("turn").over(w))
    pair = F.concat("before", "letter")
    flags = [
        F.coalesce(F.sum((~pair.isin("su", "ua", "au")).cast("long")), F.lit(0)).alias("illegal"),
        F.sum(F.when(F.col("turn").isNotNull() & ~_same("turn", "turn_before"), 1).otherwise(0)).alias("turns"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by("letter", "pos").alias("first"), F.max_by("letter", "pos").alias("final"),
        F.min_by("turn", "pos").alias("turn_first"), F.max_by("turn", "pos").alias("turn_final"),
        F.sort_array(F.collect_list(F.struct("pos", "letter", "role", "text", "last"))).alias("rows"),
    ]
    found = rows.groupBy("conv_id", "block").agg(*flags)
    found = found.join(again, _same("conv_id", "c") & (F.col("block") == F.col("b")), "left").drop("c", "b")
    fault = lambda x: F.when(x["last"] == "", "blank").when(F.coalesce(F.array_contains("again", x["pos"]), F.lit(False)), "duplicate").when(~x["last"].isin(".", "!", "?"), "truncated").otherwise("")
    turns = F.transform("rows", lambda x: F.struct(x["letter"].alias("letter"), x["role"].alias("role"), x["text"].alias("text"), fault(x).alias("fault")))
    found = found.withColumn("rows", turns).drop("again")
    count = lambda what: F.size(F.filter("rows", lambda x: x["fault"] == what)).cast("long").alias(what)
    return found.select("*", count("blank"), count("duplicate"), count("truncated"), F.size("rows").alias("n"))


_SUMS = ("illegal", "turns", "blank", "duplicate", "truncated")


def _level(blocks: DataFrame, shift: int) -> DataFrame:
    """Blocks of a conversation that share the upper bits of their positions, joined in order."""
    above = F.shiftright("block", shift - BLOCK) if shift < 63 else F.lit(0)
    names = ["block", "low", "high", "first", "final", "turn_first", "turn_final", "ways", *_SUMS]
    parts = blocks.groupBy("conv_id", above.alias("above")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("p"))
    p, k = F.col("p"), F.size("p")
    rest = F.slice("p", 2, F.greatest(k - 1, F.lit(0)))
    ways = F.transform(p[0]["ways"], lambda first: F.aggregate(rest, first, lambda v, x: _joined(v, x["ways"])))
    seams = F.transform(F.slice("p", 1, k - 1), lambda a, i: F.struct(a.alias("a"), p[i + 1].alias("b")))
    total = lambda c: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[c])
    bad = F.size(F.filter(seams, lambda s: ~F.concat(s["a"]["final"], s["b"]["first"]).isin("su", "ua", "au"))).cast("long")
    twice = F.size(F.filter(seams, lambda s: s["a"]["turn_final"] == s["b"]["turn_first"])).cast("long")
    sums = {**{c: total(c) for c in _SUMS}, "illegal": total("illegal") + bad, "turns": total("turns") - twice}
    end = F.element_at(p, -1)
    return parts.select("conv_id", p[0]["block"].alias("block"), F.array_min(F.transform(p, lambda x: x["low"])).alias("low"), F.array_max(F.transform(p, lambda x: x["high"])).alias("high"), p[0]["first"].alias("first"), end["final"].alias("final"), p[0]["turn_first"].alias("turn_first"), end["turn_final"].alias("turn_final"), ways.alias("ways"), *(v.alias(c) for c, v in sums.items()))


def _segments(audit: Column, sizes: Column) -> Column:
    """edits and before of each block: ``I*`` and one letter for each of its rows, the last also what is inserted at the end; user and assistant turns ahead of it."""
    tokens = F.regexp_extract_all(audit, F.lit("I*[DKLR]"), F.lit(0))
    starts = F.aggregate(sizes, F.array(F.lit(1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    end = F.regexp_extract(audit, "(I*)$", 1)
    cut = lambda t, s: F.transform(sizes, lambda n, i: F.concat(F.array_join(F.slice(t, s[i], n), ""), F.when(i == F.size(sizes) - 1, end).otherwise("")))
    parts = let(tokens, lambda t: let(starts, lambda s: cut(t, s)))
    return let(parts, lambda x: F.transform(x, lambda e, i: F.struct(e.alias("edits"), _emitted(F.slice(x, F.lit(1), i)).alias("before"))))


def _emitted(edits: Column) -> Column:
    """User and assistant turns that an array of edits leaves or makes."""
    return F.length(F.translate(F.array_join(edits, ""), "DL", ""))


def _repaired(rows: Column, edits: Column, before: Column) -> Column:
    """The turns (role, text) that a block's rows become. Behind ``before`` user and assistant turns the next one is the user's if that is even."""
    role = lambda n: F.when(n % 2 == 0, USER).otherwise(ASSISTANT)
    turn = lambda who, text: F.struct(who.alias("role"), text.alias("text"))

    def one(token: Column, row: Column, ahead: Column) -> Column:
        more, letter = F.length(F.translate(token, "DKLR", "")), F.substring(token, -1, 1)
        put = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k < more), lambda k: turn(role(ahead + k), F.lit("")))
        own = F.when(letter.isin("K", "L"), F.array(turn(row["role"], row["text"]))).when(letter == "R", F.array(turn(role(ahead + more), row["text"])))
        return F.when(letter.isin("D", "I"), put).otherwise(F.concat(put, own))

    tokens = F.regexp_extract_all(edits, F.lit("I*[DKLR]|I+$"), F.lit(0))
    return let(tokens, lambda t: F.flatten(F.transform(t, lambda x, i: one(x, F.get(rows, i), before + _emitted(F.slice(t, F.lit(1), i))))))


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns (role, text): each conversation's faults and cheapest repair.

    Rows come in order of turn (nulls first), then role and text. A null role or text is one space; a text without words
    is blank. Edits: see the constants above; blank and duplicate rows are deleted, truncated ones that stay cost CUT more.
    A null conversation is one of its own; rows repeated in full are duplicates; an empty table gives no rows; extra columns
    don't matter. Texts are taken whole: a conversation's repaired turns and its audit are one value each, 2 GB at most.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    spark = rows.sparkSession
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    with dropped(spark) as outlive:
        blocks = staged(_blocks(_ordered(rows)), "turn-blocks")
        blocks = blocks.join(_spans(blocks), _same("conv_id", "c"), "left").drop("c")
        begins = F.when(F.col("block") > F.col("from"), F.array(*map(_begin, STATES))).otherwise(F.array(_begin(NONE)))
        blocks = staged(blocks.withColumn("ways", F.transform(begins, lambda b: folded(F.col("rows"), b))), "turn-ways")
        end = _end(F.col("ways")[0])
        gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("turns")), F.lit(0))
        told = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal"]
        short = blocks.filter("from is null").withColumn("end", end)
        short = short.select(*told, F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"), _repaired(F.col("rows"), F.col("end.audit"), F.lit(0)).alias("repaired"))
        parts = blocks.filter("from is not null")
        whole = parts.drop("rows", "n")
        for shift in LEVELS:
            whole = _level(whole, shift)
        whole = staged(whole.withColumn("end", end).select(*told, F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit")), "turn-audits")
        sizes = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("sizes")).withColumnRenamed("conv_id", "c")
        cut = whole.select("conv_id", "audit").join(sizes, _same("conv_id", "c"))
        cut = cut.select(F.col("c"), F.posexplode(F.arrays_zip(F.col("sizes.block").alias("block"), _segments(F.col("audit"), F.col("sizes.n")).alias("x"))).alias("i", "s"))
        cut = cut.select("c", F.col("s.block").alias("b"), F.col("s.x.edits").alias("edits"), F.col("s.x.before").alias("before"))
        lines = parts.join(cut, _same("conv_id", "c") & (F.col("block") == F.col("b")))
        lines = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", _repaired(F.col("rows"), F.col("edits"), F.col("before")).alias("t")))).alias("t"))
        lines = lines.select(F.col("conv_id").alias("c"), F.flatten("t.t").alias("repaired"))
        long_ = whole.join(lines, _same("conv_id", "c")).drop("c")
        found = short.unionByName(long_).withColumn("audit", F.translate("audit", "L", "K")).withColumnRenamed("repaired", "turns")
        return outlive(found, "turns-repaired")


def _spans(blocks: DataFrame) -> DataFrame:
    """c and from, its first block, of each conversation of several blocks: at most one a block's end."""
    spans = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.min("block").alias("from"), F.max("block").alias("to"))
    return spans.filter(F.col("from") < F.col("to")).drop("to")


def repair_digests(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repair of damaged rows, one row for each conversation of ``rows``: counts, cost, audit and the digest of its repaired lines. No rows after damage: zeros."""
    found = repaired(damaged(rows, conv_col, turn_col, role_col, text_col))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    found = found.select(F.col("conv_id").alias("c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line, 256).alias("repaired_sha256"))
    every = rows.select(F.col(conv_col).alias("conv_id")).distinct().join(found, _same("conv_id", "c"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
