"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from claimweave.llm import auction, conversations

FULL = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit) from every row and state to the end, the least of both; rows are (initial, must go, truncated)."""
    best = {(len(rows), s): (0, "") for s in ("", "a")}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            initial, gone, cut = rows[i]
            for s in NEXT:
                ways = [(2, "D", s)]
                if not gone:
                    more = 5 if cut else 0
                    if initial == NEXT[s] or (initial == "s" and s == ""):
                        ways.append((more, "K", initial))
                    ways.append((1 + more, "R", NEXT[s]))
                found = [(c + best[i + 1, to][0], x + best[i + 1, to][1]) for c, x, to in ways if (i + 1, to) in best]
                if found:
                    best[i, s] = min(found)
        for _ in range(4):
            for s in NEXT:
                if (i, NEXT[s]) in best:
                    c, x = best[i, NEXT[s]]
                    best[i, s] = min(best.get((i, s), (10**9, "")), (c + 5, "I" + x))
    return best[0, ""]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if v is None else v for v in (conv, turn, role, text)]
        d = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", show[3]) if d == 2 else show[3]
            out += [(conv, turn, "user" if d == 4 else show[2], text)] * (2 if d == 3 else 1)
    return out


def expected(table):
    by = defaultdict(list)
    for row in table:
        by[row[0]] += damaged([row])
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in rows:
            found = FULL.findall(text)
            faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = cheapest([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
        made, state, i = [], "", 0
        for x in audit:
            if x in "IR":
                state = NEXT[state]
                made.append((ROLES[state], "" if x == "I" else rows[i][3]))
            elif x == "K":
                state = rows[i][2][:1]
                made.append(rows[i][2:])
            i += x != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def table(seed, sizes):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " ", "", "Go on!\n", "A longer text without an end", "été. ", None]
    rows = []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rnd.choices(["system", "user", "assistant", "tool", "", None], [2, 10, 10, 1, 0.3, 0.3])[0]
            text = rnd.choice(texts) if rnd.random() < 0.4 else f"turn {rnd.randrange(n)}{rnd.choice(['.', '', '!'])}"
            rows.append((conv, None if rnd.random() < 0.02 else turn + (rnd.random() < 0.05), role, text))
    return rows + [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (7000, None, None, None)] + [(7001, 4, "user", "Same.")] * 3


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, stretch, fan", [(1, 64, 256), (2, 4, 3)])
def test_equals_dynamic_programme(spark, seed, stretch, fan):
    rows = table(seed, [0, 1, 2, 3, 4, 5, 8, 8, 9, 16, 17, 33, 64, 65, 130] + [random.Random(seed).randrange(12) for _ in range(150)])
    got = conversations.audit(spark.createDataFrame(rows, SCHEMA), stretch=stretch, fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_auction_on_many_small_lattices():
    rnd = random.Random(5)
    names = ["", "s", "u", "a"]
    for _ in range(2000):
        rows = [(rnd.randrange(4), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randrange(12))]
        lattice = auction.Lattice(rows, auction.DONE, True)
        cost = lattice.cost(auction.EMPTY)
        want = cheapest([(names[i] or "x", f in (1, 2), f == 3) for i, f in rows])
        assert (cost, lattice.trace(auction.EMPTY)[0]) == want
        cut = rnd.randrange(len(rows) + 1)  # two stretches, put together
        whole = auction.before(auction.product(auction.transfer(rows[:cut], False), auction.transfer(rows[cut:], True)), [0] + [auction.NEVER] * 3)
        assert whole[auction.EMPTY] == cost


def test_odd_tables(spark):
    assert conversations.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, 1, "user", "word " * 400_000 + "end."), (3, 2, "assistant", "Fine."), (4, 0, "system", "Be kind.")]
    more = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos long, conv string")
    assert sorted(map(tuple, conversations.audit(more).collect())) == expected(rows)
