"""Operator 12: repair of conversation structure by an auction for the cheapest edits.

A conversation is whole if its role initials read as an optional s and then user-assistant pairs (or
nothing at all). Rows are kept, given another role, deleted or inserted at integer costs; blank rows and
rows seen earlier must go. The cheapest edits are shortest paths on a lattice of (row, state), found by
the auction of ``auction.py``; ties go to the edits whose initials come first in ASCII.

How a conversation of any length is handled: rows are numbered over range parts and cut into stretches
of ``STRETCH`` rows. Each stretch of a longer conversation yields the costs between its border states;
these are combined in a tree of fan-out ``FAN`` to the exact price of every state at every border. Each
stretch is then solved against the prices behind it, for every state it may be entered in, and the
entered states are carried forward by the same tree. No task holds more than a stretch or FAN borders.
Only the digest streams a conversation's repaired rows through one task, holding one row at a time, as a
hash can't be computed otherwise; the audit is one string a conversation by contract.

Defined results: rows are ordered by turn (nulls first), then by role and a hash of the text, so ties
are equal at every run; a null role or text is one space; a null ``conv_id`` is one conversation of
its own; repeated rows are duplicates; very long texts are never copied but into their own row; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimweave.checkpoints import new_folder
from claimweave.llm import auction
from claimweave.operators.ranking import numbered

STRETCH = 64
FAN = 256
SPACES = " \t\n\x0b\x0c\r"
#: Marks in a stretch besides rows: a row not seen earlier, the initial before, a stretch behind.
FIRST_SEEN, BEFORE, BEHIND = 16, 17, 21
CODES = 32


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, f"conversations-{name}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _plain(conversations: DataFrame) -> DataFrame:
    """Key, turn, role and text; nulls are one space (the turn stays a number)."""
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat or rename rows (conv, turn, role, text) by a hash of their place."""
    place = F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    drawn = rows.withColumn("_draw", F.crc32(place) % 20).filter("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_draw") == 3, 2).otherwise(1)
    return drawn.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def _code(initial: Column, core: Column) -> Column:
    """4 x initial + fault, duplicates aside."""
    at = F.when(initial == "s", auction.SYSTEM).when(initial == "u", auction.USER).when(initial == "a", auction.ASSISTANT).otherwise(auction.EMPTY)
    fault = F.when(core == "", auction.BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), auction.SOUND).otherwise(auction.TRUNCATED)
    return (4 * at + fault).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their position from 0 in their conversation, their code and a digest of role and text; laid down."""
    digest = F.md5(F.concat("role", F.lit("\0"), "text"))
    coded = rows.select("*", _code(F.substring("role", 1, 1), F.rtrim("text", F.lit(SPACES))).alias("code"), digest.alias("digest"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return _stored(numbered(coded, ["conv"], order, "pos").withColumn("pos", F.col("pos") - 1), "rows")


def _stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """(conv, k, marks): per stretch, place x CODES + mark."""
    k, at = F.floor(F.col("pos") / stretch), F.col("pos") % stretch
    first = rows.groupBy("conv", "digest").agg(F.min("pos").alias("pos"))
    # each border is told to both sides: the initial before it, and that something is behind it
    sides = rows.filter(at == stretch - 1).select("conv", (k + 1).alias("k"), (BEFORE + F.floor(F.col("code") / 4)).alias("mark"))
    behind = rows.filter((at == 0) & (F.col("pos") > 0)).select("conv", (k - 1).alias("k"), F.lit(BEHIND).cast("long").alias("mark"))
    marks = rows.select("conv", k.alias("k"), (at * CODES + F.col("code")).alias("mark"))
    marks = marks.unionByName(first.select("conv", k.alias("k"), (at * CODES + FIRST_SEEN).alias("mark"))).unionByName(sides).unionByName(behind)
    grouped = marks.groupBy("conv", "k").agg(F.collect_list(F.col("mark").cast("int")).alias("marks"))
    return _stored(grouped.filter(F.exists("marks", lambda m: m % CODES < FIRST_SEEN)), "stretches")


def _read(marks: list[int]) -> tuple[list[tuple[int, int]], int | None, bool]:
    """Rows (initial, fault), the initial before them, and whether a stretch follows."""
    codes, seen, earlier, behind = {}, set(), None, False
    for mark in marks:
        at, code = divmod(mark, CODES)
        if code < FIRST_SEEN:
            codes[at] = code
        elif code == FIRST_SEEN:
            seen.add(at)
        elif code == BEHIND:
            behind = True
        else:
            earlier = code - BEFORE
    rows = []
    for at in sorted(codes):
        initial, fault = divmod(codes[at], 4)
        rows.append((initial, auction.DUPLICATE if at not in seen and fault != auction.BLANK else fault))
    return rows, earlier, behind


def _map(df: DataFrame, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows made from each row's values."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            made = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in fn(*row)]
            columns = zip(*made, strict=True) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def carry(items: DataFrame, step: Callable, combine: Callable, start: list[int], backward: bool, fan: int = FAN) -> DataFrame:
    """(conv, k, v): what is carried into each item (conv, k, m), in the order of k or against it.

    ``step(v, m)`` carries over one item, ``combine(m, n)`` makes one of two that follow each other. Items
    are combined in groups of ``fan``, level by level, and the values handed down again.
    """
    levels, level = [], items
    while True:
        groups = level.groupBy("conv", F.floor(F.col("k") / fan).alias("g")).agg(F.collect_list(F.struct("k", "m")).alias("items"))
        levels.append(groups := _stored(groups, "groups"))
        if not groups.filter("g > 0").limit(1).count():
            break

        def whole(conv, g, items):
            m = None
            for x in sorted(items, key=lambda x: x["k"], reverse=backward):
                m = x["m"] if m is None else combine(m, x["m"])
            return [(conv, g, m)]

        level = _map(groups, whole, "conv string, k long, m array<long>")

    def hand_down(conv, g, items, v):
        out = []
        for x in sorted(items, key=lambda x: x["k"], reverse=backward):
            out.append((conv, x["k"], v))
            v = step(v, x["m"])
        return out

    values = levels[-1].select("conv", "g", F.lit(None).cast("array<long>").alias("v"))
    for groups in reversed(levels):
        joined = groups.join(values.select("conv", "g", "v"), ["conv", "g"]).select("conv", "g", "items", F.coalesce("v", F.array(*(F.lit(x).cast("long") for x in start))).alias("v"))
        values = _map(joined, hand_down, "conv string, k long, v array<long>").withColumnRenamed("k", "g")
    return values.withColumnRenamed("g", "k")


def _solve(conv, k, marks, beyond):
    """Counts of a stretch and, per state it may be entered in, the cost, the edits and the state it is left in."""
    rows, earlier, behind = _read(marks)
    faults = [fault for _, fault in rows]
    initials = ([earlier] if earlier is not None else []) + [initial for initial, _ in rows]
    legal = {(auction.SYSTEM, auction.USER), (auction.USER, auction.ASSISTANT), (auction.ASSISTANT, auction.USER)}
    illegal = sum(pair not in legal for pair in zip(initials, initials[1:]))
    lattice = auction.Lattice(rows, beyond if behind else auction.DONE, not behind)
    costs, audits, exits = [], [], []
    for origin in range(auction.STATES if k else 1):
        costs.append(lattice.cost(origin))
        audit, state = lattice.trace(origin) if costs[-1] < auction.NEVER else ("", 0)
        audits.append(audit)
        exits.append(state)
    return [(conv, k, *(faults.count(f) for f in (auction.BLANK, auction.DUPLICATE, auction.TRUNCATED)), illegal, costs, audits, exits)]


SOLVED = "conv string, k long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, exits array<long>"


def solve(rows: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """Per stretch of placed rows: (conv, k, blank, duplicate, truncated, illegal, cost, audit, state); cost is the whole rest's."""
    stretches = _stretches(rows, stretch)
    longer = stretches.filter("k > 0").select("conv").distinct()
    many = stretches.join(longer, "conv", "left_semi")

    def transfers(conv, k, marks):
        read, _, behind = _read(marks)
        return [(conv, k, auction.transfer(read, not behind))]

    matrices = _map(many.select("conv", "k", "marks"), transfers, "conv string, k long, m array<long>")
    end = [0, auction.NEVER, auction.NEVER, auction.NEVER]  # the last stretch's first column is the cost to a whole end
    prices = carry(matrices, lambda v, m: auction.before(m, v), lambda m, n: auction.product(n, m), end, True, fan)
    priced = stretches.join(prices.withColumnRenamed("v", "beyond"), ["conv", "k"], "left")
    solved = _stored(_map(priced.select("conv", "k", "marks", "beyond"), _solve, SOLVED), "solved")
    # the first stretch has one way in; the others' are its exits carried on
    ways = solved.join(longer, "conv", "left_semi").select("conv", "k", F.col("exits").alias("m"))
    entered = carry(ways, lambda v, m: [m[v[0]]], lambda m, n: [n[x] for x in m], [auction.EMPTY], False, fan)
    chosen = solved.join(entered, ["conv", "k"], "left").withColumn("state", F.coalesce(F.col("v")[0], F.lit(auction.EMPTY).cast("long")))
    at = F.col("state").cast("int")
    return _stored(chosen.select("conv", "k", "blank", "duplicate", "truncated", "illegal", F.get("costs", at).alias("cost"), F.get("audits", at).alias("audit"), "state"), "chosen")


def edits(solved: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, pos, step, edit, role): one row an edit in order; insertions stand before the row at pos, the role is that of chosen ones."""

    def spell(conv, k, audit, state, initials):
        out, pos = [], k * stretch
        for step, letter in enumerate(audit):
            if letter in "IR":
                state = auction.following(state)
            elif letter == "K":
                state = initials[pos - k * stretch]
            out.append((conv, pos, step, letter, auction.ROLE_OF[state] if letter in "IR" else None))
            pos += letter != "I"
        return out

    return _map(solved.select("conv", "k", "audit", "state", "initials"), spell, "conv string, pos long, step long, edit string, role string")


def repair(rows: DataFrame, solved: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The repaired rows (conv, pos, step, edit, role, text), ordered by pos and step in a conversation."""
    k = F.floor(F.col("pos") / stretch).alias("k")
    initials = rows.groupBy("conv", k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.floor(x["code"] / 4)).alias("initials"))
    made = edits(solved.join(initials, ["conv", "k"]), stretch).filter("edit <> 'D'")
    kept = made.filter("edit <> 'I'").join(rows.select("conv", "pos", F.col("role").alias("own"), "text"), ["conv", "pos"])
    kept = kept.select("conv", "pos", "step", "edit", F.coalesce("role", "own").alias("role"), "text")
    return kept.unionByName(made.filter("edit = 'I'").withColumn("text", F.lit("")))


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): rows of a conversation pass in order, one at a time."""

    def run(batches):
        now, sha, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c) for c in ("conv", "role", "text")), strict=True):
                if (key := conv.as_py()) != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(role.as_buffer())
                sha.update(b":")
                sha.update(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], names=["conv", "repaired_sha256"])
            out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "pos", "step")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def audit(conversations: DataFrame, damaged: bool = True, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """Per original conv_id the counts of faults, the cost and initials of the cheapest edits, and the digest of the result."""
    plain = _plain(conversations)
    rows = placed(damage(plain) if damaged else plain)
    solved = solve(rows, stretch, fan)
    turns = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "audit"))), lambda x: x["audit"]), "")
    told = solved.groupBy("conv").agg(*counts, F.max(F.when(F.col("k") == 0, F.col("cost"))).alias("cost"), letters.alias("audit"))
    digests = _digests(repair(rows, solved, stretch))
    known = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    joined = known.join(turns, "conv", "left").join(told, "conv", "left").join(digests, "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
